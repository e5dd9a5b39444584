"""Sources, sinks, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemill.functions.payload import shorten
from telemill.operators import columns, models, quality, splits
from telemill.sources import blobs, io
from telemill.sources.scratch import scratch

from .catalog import query, table


@query("S1 S3 S8 S15 S9 S31", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "customer") + ".csv"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    io.write(rows, path)
    return io.read(spark, path, schema=rows.schema).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("S2 S14 S16 S17 S18 S19 S20", "SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS remark FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def append_to_fixed_schema(spark, sf_dir):
    schema = StructType.fromDDL("key int, name string, remark string")
    path = scratch(spark, "places") + ".parquet"
    nation, region = (table(spark, sf_dir, t).withColumnsRenamed({f"{t[0]}_{t}key": "key", f"{t[0]}_name": "name"}) for t in ("nation", "region"))
    io.write(io.conform(nation.where("false"), schema), path)
    for part in (nation, region.withColumn("extra", F.lit(None))):
        io.append_conforming(part, path, schema)
    return io.read(spark, path)


@query("S21 S22 S23 E15", "SELECT 'document:' || sha256(text) AS ref, max(strlen(text))::BIGINT AS nbytes FROM documents WHERE trim(text) <> '' GROUP BY 1")
def blob_store(spark, sf_dir):
    path = scratch(spark, "blobs")
    docs = table(spark, sf_dir, "documents")
    for part in (docs.where("lang = 'en'"), docs):
        blobs.insert_ignore(spark, blobs.blobs(part, "text", "document"), path)
    return blobs.stored(spark, path).select("ref", "nbytes")


@query("S4 S6 S7 S10 S11 S13 F3 P7 P22", "SELECT doc_id, lang, n_chars FROM documents WHERE source IS NULL OR source <> 'src0'")
def load_dataset(spark, sf_dir):
    return io.load_dataset(spark, f"{sf_dir}/documents.parquet", ["lang", "n_chars", "lang", "absent"], "doc_id", device="source", without=["src0"])


@query("S5 V15", "SELECT 'lineitem' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def row_counts(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows")
    return one("lineitem").unionByName(one("orders"))


@query("P3 P9 P11 P23 H1", "SELECT coalesce(o_orderkey::VARCHAR, '') AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders")
def drop_and_stringify(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    _, _, names = columns.drops(o.columns, ["o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "nothing"], keep=["o_orderstatus"])
    return o.select(*[F.coalesce(F.col(io.quoted(n)).cast("string"), F.lit("")).alias(n) for n in names])


@query("J9 J12 H5", "SELECT 'p_partkey unique' AS \"check\", (count(*) - count(DISTINCT p_partkey))::BIGINT AS violations, count(*) = count(DISTINCT p_partkey) AS ok FROM part UNION ALL SELECT 'l_orderkey unique', (count(*) - count(DISTINCT l_orderkey))::BIGINT, count(*) = count(DISTINCT l_orderkey) FROM lineitem")
def join_preconditions(spark, sf_dir):
    return quality.unique(table(spark, sf_dir, "part"), "p_partkey").unionByName(quality.unique(table(spark, sf_dir, "lineitem"), "l_orderkey"))


@query("T7", "SELECT l_returnflag, arg_max(l_linestatus, (r, l_linestatus)) AS best, round(max(r), 6) AS value FROM (SELECT l_returnflag, l_linestatus, avg(l_discount) AS r FROM lineitem GROUP BY ALL) GROUP BY 1")
def best_per_group(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("r"))
    return r.groupBy("l_returnflag").agg(F.max_by("l_linestatus", F.struct("r", "l_linestatus")).alias("best"), F.round(F.max("r"), 6).alias("value"))


@query(
    "E2 E3 E4 E6 E7 E20",
    "SELECT p_partkey, replace(lower(trim(p_name)), ' ', '') AS folded, reverse(p_brand) AS turned, starts_with(p_type, 'S') AS starts, regexp_extract(p_brand, '[0-9]+') AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS replaced, string_split(p_name, ' ')[-1] AS last, try_cast(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS number, round(ln(1 + p_retailprice), 6) AS scaled, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short FROM part",
)
def scalar_functions(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    digits = F.regexp_extract(brand, "[0-9]+", 0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("")).alias("folded"), F.reverse(brand).alias("turned"), F.col("p_type").startswith("S").alias("starts"), digits.alias("digits"),
        F.regexp_replace(name, "[aeiou]", "_").alias("replaced"), F.element_at(F.split(name, " "), -1).alias("last"), digits.try_cast("long").alias("number"), F.round(F.log(1 + F.col("p_retailprice")), 6).alias("scaled"), shorten(name, 12).alias("short"),
    )


_FOLDS = (
    "WITH RECURSIVE s AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS i FROM customer GROUP BY 1),"
    " r(i, load, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0 UNION ALL SELECT s.i, [CASE WHEN k = list_position(load, list_min(load)) THEN load[k] + n ELSE load[k] END FOR k IN [1, 2, 3, 4, 5]], (list_position(load, list_min(load)) - 1)::INT FROM r JOIN s ON s.i = r.i + 1)"
    " SELECT g AS c_nationkey, fold, n AS rows FROM r JOIN s USING (i)"
)


@query("M2", _FOLDS)
def group_folds(spark, sf_dir):
    """Folds of nations by their customers."""
    return splits.group_folds(table(spark, sf_dir, "customer"), "c_nationkey")


@query("M4 M7")
def feature_importance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 110_000).alias("target"))
    split = splits.group_holdout(li, "l_orderkey", 42)
    features = ["l_quantity", "l_discount", "l_tax"]
    model, m = models.fit_and_score(split.where("not is_test"), split.where("is_test"), features, "target", "forest", numTrees=5, maxDepth=4)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in models.importance(model, m.features)], "feature string, importance double")


@query("E1", "SELECT n_nationkey AS key, n_name || ' it''s \\' || chr(10) || n_nationkey AS text FROM nation WHERE n_name || ' it''s \\' <> 'FRANCE it''s \\'")
def quoted_names(spark, sf_dir):
    """Names and texts with quotes, backslashes and line ends, written into SQL."""
    name, odd = "a `b' \"c", " it's \\"
    rows = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", name)
    parts = f"n_name || {io.literal(odd)}"
    return rows.selectExpr(f"{io.quoted(name)} AS key", f"{parts} || {io.literal(chr(10))} || {io.quoted(name)} AS text").where(
        f"substring_index(text, {io.literal(chr(10))}, 1) <> {io.literal('FRANCE' + odd)}"
    )
