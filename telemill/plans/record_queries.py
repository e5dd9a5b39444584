"""Execution records: lists and manifests of columns, documents beside the data, release checks, and the whole build."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from telemill.operators import columns, quality, record_columns
from telemill.sources import io
from telemill.sources.scratch import scratch

from . import stages
from .catalog import query, table

_CITY = "replace(lower(n_name), ' ', '_')"


@query("S24 H15", "SELECT o_orderstatus AS pool, 'scores_' || o_orderstatus || '/prices.json' AS file, count(*) AS n, round(avg(o_totalprice), 4) AS mean, 42::BIGINT AS seed FROM orders GROUP BY 1")
def result_documents(spark, sf_dir):
    """Results of each pool, written with the seed into the pool's folder and read again by selectors."""
    base = scratch(spark, "results")
    out = []
    for r in table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).collect():  # one row a pool
        path = io.save_result(spark, {"scores": {"n": r.n, "mean": [r.mean]}}, 42, f"{base}/scores", "prices.json", r.o_orderstatus)
        text = io.read_document(spark, path)
        out.append((r.o_orderstatus, path.removeprefix(f"{base}/"), io.select_value(text, "scores.n"), round(io.select_value(text, "scores.mean.0"), 4), io.select_value(text, "seed")))
    return spark.createDataFrame(out, "pool string, file string, n long, mean double, seed long")


_REPORTED = ("l_orderkey AS job_id", "l_quantity AS sc_cryo_t__mean", "CASE WHEN l_returnflag = 'R' THEN l_tax END AS QB1_t1_time", "l_discount AS hellinger_native", "l_linenumber AS sc_cryo_t__count")


@query(
    "S25",
    f"WITH r AS (SELECT {', '.join(_REPORTED)} FROM lineitem) SELECT c AS \"column\", action, n AS \"values\", (count(*) OVER (PARTITION BY action))::BIGINT AS of_action FROM (SELECT 'job_id' AS c, 'id' AS action, count(job_id) AS n FROM r UNION ALL SELECT 'sc_cryo_t__mean', 'feature', count(sc_cryo_t__mean) FROM r UNION ALL SELECT 'QB1_t1_time', 'feature', count(QB1_t1_time) FROM r UNION ALL SELECT 'hellinger_native', 'target', count(hellinger_native) FROM r UNION ALL SELECT 'sc_cryo_t__count', 'drop', count(sc_cryo_t__count) FROM r)",
)
def column_report(spark, sf_dir):
    """The report on columns, written as JSON and read again."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_REPORTED)
    counts = {c: f["count"] for c, f in quality.column_facts(rows, rows.columns).items()}
    path = scratch(spark, "report") + ".json"
    io.write_document(spark, io.column_report(columns.decide(rows.columns), counts), path)
    report = json.loads(io.read_document(spark, path))
    return spark.createDataFrame([(r["column"], r["action"], r["values"], report["actions"][r["action"]]) for r in report["columns"]], "column string, action string, values long, of_action long")


@query(
    "S26",
    "WITH m AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY p) + 2 AS line, '| ' || p || ' | ' || n || ' | ' || printf('%.1f', a) || ' |' AS text FROM m) SELECT line::BIGINT AS line, text FROM l UNION ALL SELECT 1, '| priority | n | mean |' UNION ALL SELECT 2, '| --- | --- | --- |'",
)
def markdown_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).orderBy("o_orderpriority").collect()  # five priorities
    path = scratch(spark, "table") + ".md"
    io.write_document(spark, io.markdown_table(["priority", "n", "mean"], [tuple(r) for r in rows]), path)
    lines = io.read_document(spark, path).splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


@query("S27 P6", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def listed_columns(spark, sf_dir):
    """Columns that a list file names, less those that another drops."""
    base = scratch(spark, "lists")
    io.write_document(spark, "# wanted\nl_orderkey  # the key\n\nl_quantity\nl_discount\nl_quantity\nl_tax\n", f"{base}/keep.txt")
    io.write_document(spark, "l_discount\n#l_tax\n", f"{base}/drop.txt")
    wanted, unwanted = (io.name_list(spark, f"{base}/{n}.txt") for n in ("keep", "drop"))
    li = table(spark, sf_dir, "lineitem")
    _, _, names = columns.drops([c for c in li.columns if c in wanted], unwanted)
    return li.select(*names)


#: Entries of a manifest, which is one document.
MOST_LISTED = 100_000


def _listed(df, key):
    """The rows of a manifest, by key; more than a document should hold are an error."""
    rows = df.limit(MOST_LISTED + 1).collect()
    if len(rows) > MOST_LISTED:
        raise ValueError("too many entries for a manifest")
    return sorted(rows, key=lambda r: r[key])


@query(
    "S28 H16 P14",
    f"WITH n AS (SELECT n_nationkey, {_CITY} AS city, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0) SELECT 'Lab/' || city || '-T' AS path, 'sensor' AS kind, lower(r_name) AS category, 'lab__' || city || '_t' AS name, n_nationkey % 2 = 0 AS in_data FROM n UNION ALL SELECT 'QB' || n_nationkey || '/t1_time', 'qubit', NULL, 'QB' || n_nationkey || '_t1_time', n_nationkey % 2 = 0 FROM nation WHERE n_nationkey % 5 = 0",
)
def manifest_lookup(spark, sf_dir):
    """Channels of a manifest with switched-off entries, and which of them a table has as columns, in whatever case."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = _listed(places, "n_nationkey")
    manifest: dict = {"sensor_categories": {}, "qubits": {}}
    for r in places:
        city = r.n_name.lower().replace(" ", "_")
        manifest["sensor_categories"].setdefault(r.r_name.lower(), {"sensors": {}})["sensors"][f"Lab/{city}-T"] = {"enabled": r.n_nationkey % 7 != 0}
        manifest["qubits"][f"QB{r.n_nationkey}"] = {"enabled": r.n_nationkey % 5 == 0, "metrics": {"t1_time": {}, "frequency": {"enabled": False}}}
    path = scratch(spark, "manifest") + ".json"
    io.write_document(spark, json.dumps(manifest), path)
    channels = io.manifest_channels(io.read_document(spark, path))
    rows = spark.createDataFrame([(c["path"], c["kind"], c["category"]) for c in channels], "path string, kind string, category string")
    named = rows.withColumn("name", F.when(F.col("kind") == "sensor", columns.sensor_name(F.col("path"))).otherwise(columns.calibration_name(F.col("path"))))
    have = [f"LAB__{r.n_name.upper().replace(' ', '_')}_T__mean" for r in places if r.n_nationkey % 2 == 0] + [f"QB{r.n_nationkey}_t1_time" for r in places if r.n_nationkey % 2 == 0]
    names = [r.name for r in named.select("name").collect()]  # a manifest's channels
    found = columns.manifest_columns(have, names, ignore_case=True)
    sensors = {c.rsplit("__", 1)[0].lower() for c in found if c.endswith("__mean")} | {c for c in columns.manifest_columns(have, names, ignore_case=False)}
    return named.withColumn("in_data", F.col("name").isin(*sorted(sensors)))


@query(
    "S29 V2",
    "WITH t AS (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text, count(*) AS n FROM nation) SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS nbytes, n AS rows, 'n_nationkey,n_name,n_regionkey' AS columns, 0::BIGINT AS wrong FROM t",
)
def file_fingerprints(spark, sf_dir):
    """A file's checksum, and a footer's columns and counts against what a manifest and a text say."""
    base = scratch(spark, "files")
    nation = table(spark, sf_dir, "nation")
    names = [r.n_name for r in _listed(nation, "n_nationkey")]
    io.write_document(spark, "\n".join(names), f"{base}/names.txt")
    io.write(nation.coalesce(1), f"{base}/nation.parquet")
    schema = json.loads(io.parquet_metadata(spark, f"{base}/nation.parquet")["org.apache.spark.sql.parquet.row.metadata"])
    known = {"records": io.row_count(nation), "columns": len(nation.columns), "jobs": nation.select("n_regionkey").distinct().count()}
    said = {"manifest": dict(known), "readme": {"records": f"{known['records']:,}"}, "metadata": {"records": str(known["records"])}}
    wrong = quality.check_stated_counts(said, known)
    files = io.file_checksums(spark, f"{base}/names.txt/*.txt")
    return files.select("sha256", "nbytes", F.lit(len(names)).cast("long").alias("rows"), F.lit(",".join(f["name"] for f in schema["fields"])).alias("columns"), F.lit(len(wrong)).cast("long").alias("wrong"))


@query(
    "P14 P16 P17 P18 H12 H13",
    f"WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'sc_cal_q' || n_nationkey || '_t1' WHEN n_nationkey % 3 = 1 THEN 'sc_' || {_CITY} || '__mean' ELSE 'ion_' || {_CITY} || '__value' END AS name FROM nation) SELECT name, CASE WHEN k % 3 = 2 THEN 'trapped ion' ELSE 'superconducting' END AS device, CASE WHEN k % 3 = 0 THEN 'calibration' ELSE 'sensor' END AS kind, k % 4 <> 0 AS common, k % 3 = 2 AS leaks FROM c UNION ALL SELECT 'shots', NULL, 'program', true, false UNION ALL SELECT 'job_id', NULL, 'refused', true, false",
)
def device_column_sets(spark, sf_dir):
    """Columns of each device, columns that all data sets have, and features that a device must not use."""
    places = _listed(table(spark, sf_dir, "nation"), "n_nationkey")
    city = lambda r: r.n_name.lower().replace(" ", "_")
    name = {r.n_nationkey: f"sc_cal_q{r.n_nationkey}_t1" if r.n_nationkey % 3 == 0 else f"sc_{city(r)}__mean" if r.n_nationkey % 3 == 1 else f"ion_{city(r)}__value" for r in places}
    schemas = [["shots", "job_id", *name.values()], ["job_id", *[n for k, n in name.items() if k % 4 != 0], "shots", "other"]]
    common, rows = set(columns.common_columns(schemas)), []

    def refused(check) -> bool:
        try:
            check()
        except ValueError:
            return True
        return False

    for device in columns.DEVICE_PREFIXES:
        for kind, names in zip(("sensor", "calibration"), columns.device_columns(schemas[0], device), strict=True):
            rows += [(n, device, kind, n in common, refused(lambda n=n: columns.check_no_leakage("superconducting", [n], schemas[0]))) for n in names]
    own = columns.device_features(schemas[0], "trapped ion")
    rows.append((own[0], None, "program", own[0] in common, refused(lambda: columns.check_no_leakage("trapped ion", own, schemas[0]))))
    rows.append(("job_id", None, "refused" if refused(lambda: columns.check_no_metadata(["shots", "job_id"])) else "accepted", "job_id" in common, False))
    return spark.createDataFrame(rows, "name string, device string, kind string, common boolean, leaks boolean")


_RELEASE = """r AS (SELECT l_orderkey AS job_id, row_number() OVER () AS circuit_id, CASE WHEN l_linestatus = 'F' THEN 'superconducting' ELSE 'trapped ion' END AS device, l_quantity AS m, l_quantity - l_discount AS lo, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity - 1 ELSE l_quantity + l_tax END AS hi, l_tax - 0.02 AS sd, l_discount * 12 AS h, l_shipdate AS t FROM lineitem)"""


@query(
    "V1 V2 V3 V4 V9 V10 V11 V13 V14 V17 V19",
    f"""WITH {_RELEASE}, c AS (SELECT 'bundle' AS "check", 2 AS violations UNION ALL SELECT 'stated counts', 1 UNION ALL SELECT 'dictionary', 5 UNION ALL SELECT 'blocked names', 1 UNION ALL SELECT 'portal record', 1 UNION ALL SELECT 'channels complete', 1 UNION ALL SELECT 'published names', 0 UNION ALL SELECT 'completion anchor', 1
    UNION ALL SELECT 'no empty columns', 1 UNION ALL SELECT 'no single-valued columns', 1 UNION ALL SELECT 'circuit_id unique', 0 UNION ALL SELECT 'not filled with zeros', 0 UNION ALL SELECT 'job_id there', 0
    UNION ALL SELECT 'sc_t order', count_if(device = 'superconducting' AND (lo > m + 1e-6 OR m > hi + 1e-6)) FROM r UNION ALL SELECT 'sc_t null together', 0 UNION ALL SELECT 'sc_t deviation', count_if(device = 'superconducting' AND sd < 0) FROM r
    UNION ALL SELECT 'hellinger_native in 0..1', count_if(h > 1) FROM r UNION ALL SELECT 'ion_v__value only trapped ion', count_if(device = 'superconducting') FROM r UNION ALL SELECT 'sc_empty__value only superconducting', 0
    UNION ALL SELECT 'sc_t__' || s || ' only superconducting', 0 FROM (VALUES ('mean'), ('min'), ('max'), ('sd')) AS v(s) UNION ALL SELECT 'sc_u__mean only superconducting', 0)
    SELECT "check", violations::BIGINT AS violations, violations = 0 AS ok, (SELECT max((violations > 0)::INT) FROM c) AS exit_code FROM c""",
)
def release_report(spark, sf_dir):
    """All checks of a data set to be published, with planted faults, and the exit code."""
    li = table(spark, sf_dir, "lineitem")
    sc = F.col("l_linestatus") == "F"
    only = lambda c: F.when(sc, c)
    rows = li.select(
        F.col("l_orderkey").alias("job_id"), F.monotonically_increasing_id().alias("circuit_id"), F.when(sc, "superconducting").otherwise("trapped ion").alias("device"), F.lit("COMPLETED").alias("status"), F.lit(7).alias("batch_size"),
        only(F.col("l_quantity")).alias("sc_t__mean"), only(F.col("l_quantity") - F.col("l_discount")).alias("sc_t__min"), only(F.when(F.col("l_returnflag") == "A", F.col("l_quantity") - 1).otherwise(F.col("l_quantity") + F.col("l_tax"))).alias("sc_t__max"),
        only(F.col("l_tax") - 0.02).alias("sc_t__sd"), only(F.col("l_quantity")).alias("sc_u__mean"), F.col("l_quantity").alias("ion_v__value"), F.lit(None).cast("double").alias("sc_empty__value"), (F.col("l_discount") * 12).alias("hellinger_native"),
    )
    described = [{"column": c, "description": "see the wiki page" if c == "status" else "what it says", "source": "?" if c == "device" else "log", "group": "" if c == "job_id" else "g", "device_scope": "all"} for c in rows.columns if c != "batch_size"]
    failures, warnings = quality.check_portal_record({"title": "t", "license": "other", "creators": "FILL-IN"}, "T", "open")
    found = {
        "bundle": quality.check_bundle({"data.parquet", "extra.txt", "README.md"}, {"data.parquet", "data.csv"}, {"README.md"}),
        "stated counts": quality.check_stated_counts({"manifest": {"columns": len(rows.columns)}, "readme": {"columns": 1}}, {"columns": len(rows.columns)}),
        "dictionary": quality.check_dictionary(rows.columns, [*described, {"column": "gone", "description": "d", "source": "log", "group": "g", "device_scope": "all"}], r"wiki"),
        "blocked names": quality.blocked_names([*rows.columns, "Owner_name"], r"owner|budget"),
        "portal record": failures,
    }
    domain = {"hellinger_native in 0..1": F.col("hellinger_native").between(0, 1)}
    out = quality.validate_release(rows, found, domain=domain).cache()
    _, code = quality.report([tuple(r) for r in out.select("check", "ok", F.lit("")).collect()])  # one row a check
    return out.withColumn("exit_code", F.lit(code))


@query("V13", "SELECT 'a' AS \"column\", true AS suspect UNION ALL SELECT 'b', avg((l_tax = 0)::INT) > 0.5 FROM lineitem UNION ALL SELECT 'c', false")
def zero_filled_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0.0).alias("a"), F.col("l_tax").alias("b"), F.when(F.col("l_linestatus") == "F", 0.0).alias("c"))
    return quality.zero_filled(rows, ["a", "b", "c"]).select("column", "suspect")


_ONE = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[2]; creg c[2]; x q[0]; measure q -> c;'


@query(
    "H11 Q27 Q29 B11 J17 D7 D13",
    """WITH j AS (SELECT s_suppkey AS k, 500 + s_suppkey % 50 * 10 AS a FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 7 <> 0), p AS (SELECT k, a, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] ELSE [0] END) AS i FROM j)
    SELECT k || '_' || i AS sub_id, round(sqrt(1 - sqrt(a / 1000.0)), 6) AS hellinger_native, round(sqrt(1 - sqrt(a / 1000.0)), 6) AS hellinger_logical, CASE WHEN k % 2 = 0 THEN round(s_acctbal, 2) END AS sc_t__mean, 2::DOUBLE AS native_depth, 2::DOUBLE AS logical_n_measure, (CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)::DOUBLE AS batch_size FROM p JOIN supplier ON s_suppkey = k""",
)
def staged_build(spark, sf_dir):
    """From raw jobs to the typed data set: batches, parsing, simulation, bit order, distances, features, sensors, filters.

    Every eleventh job has no resource, every thirteenth was cancelled, every third is a batch of two, every seventh has
    a logical program that can't be read, so that it has no usable value on both sides.
    """
    k = F.col("s_suppkey")
    a = 500 + k % 50 * 10
    result = F.format_string('{"01": %d, "00": %d}', a, 1000 - a)
    twice = lambda c: F.when(k % 3 == 0, F.concat(F.lit("["), c, F.lit(","), c, F.lit("]"))).otherwise(c)
    listed = lambda text: F.when(k % 3 == 0, F.lit(json.dumps([text, text]))).otherwise(F.lit(text))
    when = F.lit("2025-07-01 10:00:00")
    jobs = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("id"), F.when(k % 11 == 0, " ").otherwise("dev").alias("executed_resource"), F.when(k % 13 == 0, "CANCELLED").otherwise("COMPLETED").alias("status"), F.lit("1000").alias("shots"),
        F.when(k % 7 == 0, listed("qreg q[")).otherwise(listed(_ONE)).alias("circuit"), listed(_ONE).alias("executed_circuit"), twice(result).alias("result"),
        *[when.alias(f"timestamp_{n}") for n in ("submitted", "scheduled", "completed")], F.lit("2025-07-01 10:00:00Z").alias("timestamp_completed_utc"), F.lit("o").alias("owner"), F.lit("b").alias("budget"),
    )
    sensors = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(k.cast("string").alias("id"), F.round("s_acctbal", 2).alias("sc_t__mean"), F.lit(3).alias("sc_t__count"))

    def cut(df):
        path = scratch(spark, "build") + ".parquet"
        io.write(df, path)
        return io.read(spark, path)

    final, _ = stages.clean(cut(stages.build(jobs, sensors, cut=cut)), sparse=0.0)
    distance = lambda c: F.round(c, 6).alias(c)
    return final.select("sub_id", distance("hellinger_native"), distance("hellinger_logical"), "sc_t__mean", "native_depth", "logical_n_measure", "batch_size")
