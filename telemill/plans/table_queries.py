"""Filters, joins, duplicates and contracts over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions.nulls import number
from telemill.operators import columns, merge, quality, stats

from .catalog import query, table


@query(
    "F1 F2 F3 A1 A3",
    "SELECT count(*) AS n_before, count_if(o_totalprice > 1000 AND length(trim(coalesce(o_orderstatus, ''))) > 0 AND o_orderpriority NOT IN ('5-LOW')) AS n_after, count_if(NOT coalesce(o_totalprice > 1000 AND length(trim(coalesce(o_orderstatus, ''))) > 0 AND o_orderpriority NOT IN ('5-LOW'), false)) AS n_removed FROM orders",
)
def preprocess_filter_counts(spark, sf_dir):
    keep = (F.col("o_totalprice") > 1000) & ~quality.is_blank(F.col("o_orderstatus")) & ~F.col("o_orderpriority").isin("5-LOW")
    return quality.removed_counts(table(spark, sf_dir, "orders"), keep)


@query("F1 P1 P2 T1", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND length(trim(coalesce(o_orderpriority, ''))) > 0 AND o_orderpriority NOT IN ('1-URGENT')")
def base_filter(spark, sf_dir):
    return quality.base_filter(table(spark, sf_dir, "orders"), "o_totalprice > 100000", "o_orderpriority", ["1-URGENT"]).select("o_orderkey", "o_orderstatus")


@query(
    "J1 J3 J4 J7 P8 P10",
    "SELECT o.o_orderkey, trim(c.c_custkey::VARCHAR) AS sensor_source_id, c.c_custkey IS NOT NULL AS sensor_merge_found, c.c_mktsegment FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey",
)
def sensor_left_merge_flagged(spark, sf_dir):
    right = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'").select("c_custkey", "c_mktsegment", F.lit(-1).alias("o_orderkey"))
    out = merge.merge_sensors(table(spark, sf_dir, "orders"), right, "o_custkey", "c_custkey")
    return out.select("o_orderkey", "sensor_source_id", "sensor_merge_found", "c_mktsegment")


@query("J7 J8", "SELECT count_if(c_custkey IS NOT NULL) AS matched, count_if(c_custkey IS NULL) AS unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def merge_match_counts(spark, sf_dir):
    right = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'").select("c_custkey")
    return merge.match_counts(merge.merge_sensors(table(spark, sf_dir, "orders"), right, "o_custkey", "c_custkey"))


@query("J5 W10 T3 U8", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def dedup_first_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = merge.one_per_key(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")


@query("J6 A4", "SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS l_returnflag FROM lineitem GROUP BY 1")
def dedup_mean_first(spark, sf_dir):
    cols = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    out = merge.mean_or_first(cols, ["l_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return out.select("l_orderkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"), "l_returnflag")


@query("J10 U2 U7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_cohort(spark, sf_dir):
    from telemill.operators.cohorts import in_ids

    ids = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return in_ids(table(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("F7 F20", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def anti_group_cancelled(spark, sf_dir):
    rows = merge.drop_groups_with(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", F.col("l_returnflag") == "R")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F4 F5 F6 J2",
    "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE (quality = 1 OR d.n_chars > 2000) AND lower(trim(d.lang)) NOT IN ('', 'nan', 'none', 'null', '<na>')",
)
def availability_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("quality").cast("string").alias("logical_dag_ok"), F.when(F.col("n_chars") > 2000, "SUCCESS").otherwise("FAILED").alias("logical_sim_status"), F.col("lang").alias("native_depth")
    )
    return quality.both_sides(rows, ["logical_dag_ok", "logical_sim_status", "absent"], ["native_depth"]).select("doc_id")


@query("F8", "SELECT CASE WHEN NOT a AND NOT b THEN 'both_failed' WHEN NOT a THEN 'logical_failed' WHEN NOT b THEN 'native_failed' END AS reason, count(*) AS n FROM (SELECT l_returnflag <> 'R' AS a, l_linestatus = 'O' AS b FROM lineitem) WHERE a OR b GROUP BY 1")
def invalid_row_policy(spark, sf_dir):
    rows = quality.invalid_rows(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", "drop_both_fail")
    return rows.groupBy(F.col("row_drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_JOINED = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)"


def _joined(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")


@query(
    "A5 A34 F16",
    f"WITH j AS ({_JOINED}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, round(count({c}) / count(*)::DOUBLE, 6) AS coverage FROM j" for c in ("doc_id", "n_chars", "quality", "toxic")),
)
def column_profile(spark, sf_dir):
    out = quality.profile(_joined(spark, sf_dir), ["doc_id", "n_chars", "quality", "toxic"])
    return out.withColumn("coverage", F.round("coverage", 6))


@query(
    "A6 F17 F18",
    f"WITH j AS ({_JOINED}), s AS (SELECT count(*) AS r, count(quality) AS q, min(quality) AS qa, max(quality) AS qb, count(toxic) AS t, min(toxic) AS ta, max(toxic) AS tb FROM j) SELECT 'dead__mean' AS \"column\", 'empty' AS reason UNION ALL SELECT 'dead__min', 'constant'",
)
def channel_bool_and(spark, sf_dir):
    j = _joined(spark, sf_dir).withColumns({"dead__mean": F.lit(None).cast("double"), "dead__min": F.lit(1.0), "live__mean": F.col("quality"), "live__min": F.lit(0.0), "zero": F.lit(0)})
    found = quality.degenerate_columns(j, ["dead__mean", "dead__min", "live__mean", "live__min", "zero", "n_chars"], exempt=["zero"])
    return spark.createDataFrame(found, "column string, reason string")


@query("P12 P13", "SELECT * FROM (VALUES ('job_id', 'id', 'identifier'), ('sc_cryo_t__mean', 'feature', 'sensor'), ('QB1_t1_time', 'feature', 'calibration'), ('native_depth', 'feature', 'circuit'), ('hellinger_native', 'target', 'target')) AS v(\"column\", action, \"group\")")
def column_classifier(spark, sf_dir):
    names = ["job_id", "sc_cryo_t__mean", "QB1_t1_time", "native_depth", "hellinger_native"]
    rows = [(c, action, columns.group_of(c)) for c, action, _ in columns.decide(names)]
    return spark.createDataFrame(rows, "column string, action string, group string")


@query("P15 P19 E4", "SELECT DISTINCT source AS path, replace(replace(lower('Cryo/' || source || '-T.1'), '/', '__'), '-', '_').replace('.', '_') AS sensor, source || '_t1' AS calibration FROM documents")
def name_normalisers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source").distinct()
    path = F.concat(F.lit("Cryo/"), F.col("source"), F.lit("-T.1"))
    cal = F.concat(F.lit("a/"), F.col("source"), F.lit("/t1"))
    return d.select(F.col("source").alias("path"), columns.sensor_name(path).alias("sensor"), columns.calibration_name(cal).alias("calibration"))


@query(
    "V5 V6 V7 V8",
    "SELECT 'discount in 0..1' AS \"check\", count_if(NOT (l_discount >= 0 AND l_discount <= 1)) AS violations, count_if(NOT (l_discount >= 0 AND l_discount <= 1)) = 0 AS ok FROM lineitem UNION ALL SELECT 'day resolution', count_if(date_trunc('day', l_shipdate) <> l_shipdate), count_if(date_trunc('day', l_shipdate) <> l_shipdate) = 0 FROM lineitem UNION ALL SELECT 'flag domain', count_if(l_returnflag NOT IN ('A', 'N')), count_if(l_returnflag NOT IN ('A', 'N')) = 0 FROM lineitem UNION ALL SELECT 'o_orderkey unique', (count(*) - count(DISTINCT o_orderkey))::BIGINT, count(*) = count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 's_suppkey dense', (CASE WHEN min(s_suppkey) <> 1 THEN 1 ELSE 0 END + abs(max(s_suppkey) - count(DISTINCT s_suppkey)))::BIGINT, min(s_suppkey) = 1 AND max(s_suppkey) = count(DISTINCT s_suppkey) FROM supplier",
)
def contract_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    checks = {"discount in 0..1": F.col("l_discount").between(0, 1), "day resolution": F.date_trunc("day", F.col("l_shipdate")) == F.col("l_shipdate").cast("timestamp"), "flag domain": F.col("l_returnflag").isin("A", "N")}
    parts = [quality.contract(li, checks), quality.unique(table(spark, sf_dir, "orders"), "o_orderkey"), quality.dense_ids(table(spark, sf_dir, "supplier"), "s_suppkey")]
    return quality.contract_table(spark, parts)


@query("V18 S30", "WITH a AS (SELECT l_returnflag AS label, avg(l_quantity) AS value FROM lineitem GROUP BY 1) SELECT l AS label, CASE WHEN a.value IS NULL THEN 'skip' WHEN abs(a.value - 25.5) <= 0.5 THEN 'ok' ELSE 'DIFF' END AS status FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS v(l) LEFT JOIN a ON a.label = l")
def regression_check(spark, sf_dir):
    expected = spark.createDataFrame([(k, 25.5, 0.5) for k in "ANRX"], "label string, value double, tolerance double")
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.avg("l_quantity").alias("value"))
    return quality.compare_expected(expected, actual).select("label", "status")


@query("E5 F18 Q19 Q20", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio, round(l_tax - l_discount, 6) AS delta, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def safe_numbers(spark, sf_dir):
    from telemill.functions.nulls import delta, ratio

    text = F.when(F.col("l_returnflag") == "N", "N/A").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"), F.round(delta(F.col("l_tax"), F.col("l_discount")), 6).alias("delta"), number(text).alias("quantity"))


@query("A2 W6 T5", "WITH c AS (SELECT o_orderstatus AS status, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY ALL) SELECT status, category, n, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, category) AS r FROM c) WHERE r <= 3")
def top_categories(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n"), "category"))
    return n.withColumn("rank", r.cast("long")).where("rank <= 3")


@query("T4", "SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1000) DESC, p_partkey LIMIT 25")
def top_by_size(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return stats.top_by_size(p, F.col("p_retailprice") - 1000, 25, "p_partkey").select("p_partkey", "p_retailprice")
