"""Programs, graphs, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.operators import circuits, graphs, merge, models, splits
from telemill.sources.scratch import scratch
from telemill.streaming import windows

from .catalog import query, table


@query(
    "Q17 B7",
    "WITH n AS (SELECT l_orderkey AS o, l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem), e AS (SELECT DISTINCT o, least(u, v) AS a, greatest(u, v) AS b FROM n WHERE v IS NOT NULL), x AS (SELECT o, a AS k FROM e UNION SELECT o, b FROM e), c AS (SELECT o, count(*) AS nodes FROM x GROUP BY 1), d AS (SELECT o, count(*) FILTER (a <> b) AS edges FROM e GROUP BY 1) SELECT o AS l_orderkey, nodes, edges, round(2.0 * edges / nullif(nodes * (nodes - 1), 0), 6)::DOUBLE AS connectedness FROM c JOIN d USING (o)",
)
def connectedness_by_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = graphs.dealt(rows, "l_orderkey").select("l_orderkey", "l_suppkey", F.lead("l_suppkey").over(w).alias("v"))
    return graphs.connectedness(pairs, ["l_orderkey"], "l_suppkey", "v").withColumn("connectedness", F.round("connectedness", 6))


_EDGES = "e AS (SELECT r_regionkey::BIGINT AS a, 10 + n_nationkey::BIGINT AS b FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT 10 + c_nationkey::BIGINT, 100 + c_custkey FROM customer UNION ALL SELECT 10 + s_nationkey::BIGINT, 10000000 + s_suppkey FROM supplier)"


@query(
    "Q18",
    f"WITH RECURSIVE {_EDGES}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT x, x FROM u UNION SELECT u.y, r.m FROM r JOIN u ON u.x = r.n WHERE r.m < u.y) SELECT n AS node, min(m) AS component FROM r GROUP BY 1",
)
def graph_components(spark, sf_dir):
    """Regions, nations, customers and suppliers; nations of one region hang on nothing above them."""
    edge = lambda df, a, b: df.select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    up = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").where("r_name != 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = edge(up, F.col("r_regionkey"), F.col("n_nationkey") + 10)
    edges = edges.unionByName(edge(table(spark, sf_dir, "customer"), F.col("c_nationkey") + 10, F.col("c_custkey") + 100))
    return graphs.components(edges.unionByName(edge(table(spark, sf_dir, "supplier"), F.col("s_nationkey") + 10, F.col("s_suppkey") + 10_000_000)))


def _programs(spark, sf_dir):
    """A program for each turn of a conversation: one gate a word, by its length."""
    gate = lambda w: F.when(F.length(w) % 3 == 0, "h q[0]; ").when(F.length(w) % 3 == 1, "cx q[0],q[1]; ").otherwise("rz(pi/4) q[2]; ")
    body = F.array_join(F.transform(F.split("text", " "), gate), "")
    text = F.concat(F.lit("OPENQASM 2.0; qreg q[4]; creg c[4]; "), body, F.lit("measure q -> c;"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.alias("program"))


@query(
    "Q3 Q4 Q7 Q8 Q15 Q16 Q21 Q22 Q25 B9",
    "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations), c AS (SELECT conv_id, turn, count(*) AS n, count_if(length(w) % 3 = 0) AS h, count_if(length(w) % 3 = 1) AS x, count_if(length(w) % 3 = 2) AS z FROM w GROUP BY ALL) SELECT conv_id, turn, true AS parse_ok, 4::DOUBLE AS n_qubits, (n + 4)::DOUBLE AS size, (h + z + 4)::DOUBLE AS n_1q_gates, x::DOUBLE AS n_2q_gates, 4::DOUBLE AS n_measure, round(x / (n + 4)::DOUBLE, 6) AS twoq_ratio, (CASE WHEN x > 0 THEN 1 ELSE 0 END)::DOUBLE AS component_count, greatest(h + x, z)::DOUBLE + 1 AS depth FROM c",
)
def circuit_features(spark, sf_dir):
    features = ["n_qubits", "size", "n_1q_gates", "n_2q_gates", "n_measure", "component_count", "depth"]
    out = circuits.with_structure(_programs(spark, sf_dir), "program", "logical", ["parse_ok", *features, "twoq_ratio"])
    return out.select("conv_id", "turn", "logical.parse_ok", *[f"logical.{c}" for c in features], F.round("logical.twoq_ratio", 6).alias("twoq_ratio"))


_GATES = "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations), c AS (SELECT conv_id, turn, count(*) AS n, count_if(length(w) % 3 = 0) AS h, count_if(length(w) % 3 = 1) AS x, count_if(length(w) % 3 = 2) AS z FROM w GROUP BY ALL)"


@query(
    "Q20 Q22",
    f"{_GATES} SELECT conv_id, turn, (greatest(h + 2 * x, z) - greatest(h + x, z))::DOUBLE AS delta_depth, x::DOUBLE AS delta_size, 0::DOUBLE AS delta_n_1q_gates, x::DOUBLE AS delta_n_2q_gates, 0::DOUBLE AS delta_n_measure, 0::DOUBLE AS delta_n_qubits, x::DOUBLE AS delta_swap_count, round((greatest(h + 2 * x, z) + 1) / (greatest(h + x, z) + 1)::DOUBLE, 6) AS ratio_depth, round((n + x + 4) / (n + 4)::DOUBLE, 6) AS ratio_gate_overhead, CASE WHEN x > 0 THEN 2.0::DOUBLE END AS ratio_twoq_overhead, NULL::DOUBLE AS ratio_swap_overhead FROM c",
)
def circuit_comparison(spark, sf_dir):
    """Each two-qubit gate of a program is followed by a swap on the other side."""
    both = _programs(spark, sf_dir).withColumn("native_program", F.replace("program", F.lit("cx q[0],q[1]; "), F.lit("cx q[0],q[1]; swap q[0],q[1]; ")))
    out = circuits.with_structures(both, {"program": "logical", "native_program": "native"}, circuits.COMPARED)
    return out.select("conv_id", "turn", *[(F.round(c, 6) if n.startswith("ratio") else c).alias(n) for n, c in circuits.comparison().items()])


@query(
    "Q9 Q10 Q12 Q13 Q14",
    "WITH s AS (SELECT s_suppkey, (s_suppkey % 5 * 100)::INT AS shots, lpad(bin(s_suppkey % 32), 5, '0') AS bits FROM supplier) SELECT s_suppkey, CASE WHEN shots > 0 THEN '{\"' || bits || '\": ' || shots || '}' END AS ideal_result_logical, CASE WHEN shots > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS logical_sim_status, CASE WHEN shots = 0 THEN 'ProgramError: shots must be positive' END AS logical_sim_error FROM s",
)
def simulate_certain_programs(spark, sf_dir):
    """Programs with one possible outcome, the key's last five bits; no shots fail."""
    k = F.col("s_suppkey")
    gates = [F.when(F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1, f"x q[{i}]; ").otherwise(f"cx q[{i}],q[{(i + 1) % 5}]; " if i == 4 else "") for i in range(5)]
    program = F.concat(F.lit("OPENQASM 2.0; qreg q[5]; creg c[5]; "), *gates, F.lit("measure q -> c;"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("best"), program.alias("program"), (k % 5 * 100).alias("shots"))
    text, _, _ = merge.first_success([("best", F.col("best")), ("program", F.col("program"))])
    out = circuits.with_ideal(rows.withColumn("text", text), "text", "shots", "s_suppkey", "logical")
    return out.select("s_suppkey", "ideal_result_logical", "logical_sim_status", "logical_sim_error")


@query(
    "H9 Q3 Q10",
    "WITH s AS (SELECT DISTINCT p_size, p_size % 6 + 1 AS k FROM part) SELECT p_size, (k + 2)::DOUBLE AS size, 2::DOUBLE AS n_gate_types, k::DOUBLE AS n_2q_gates, '{\"' || ((k + 1) // 2 % 2) || (k % 2) || '\": 10}' AS counts FROM s",
)
def custom_gates(spark, sf_dir):
    """Programs that define a gate by others (a flip, then a controlled one) and use it a number of times."""
    head = "OPENQASM 2.0; include \"qelib1.inc\"; gate both a,b { x a; cx a,b; } qreg q[2]; creg c[2]; "
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    program = F.concat(F.lit(head), F.repeat(F.lit("both q[0],q[1]; "), (F.col("p_size") % 6 + 1).cast("int")), F.lit("measure q -> c;"))
    rows = circuits.with_structure(sizes.withColumns({"program": program, "shots": F.lit(10)}), "program", "s")
    out = circuits.with_ideal(rows, "program", "shots", "p_size", "logical")
    return out.select("p_size", "s.size", "s.n_gate_types", "s.n_2q_gates", F.col("ideal_result_logical").alias("counts"))


@query("Q10 Q11 Q12 Q13")
def simulate_ideal_seeded(spark, sf_dir):
    angle = F.concat(F.lit("OPENQASM 2.0; qreg q[2]; creg c[2]; ry("), (F.col("s_suppkey") % 7).cast("string"), F.lit("*pi/7) q[0]; cx q[0],q[1]; measure q -> c;"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", angle.alias("program"), (F.col("s_suppkey") % 5 * 100).alias("shots"))
    return circuits.with_ideal(rows, "program", "shots", "s_suppkey", "logical").drop("program")


@query("Q10 Q11 Q12 Q13")
def simulate_wide_programs(spark, sf_dir):
    """Programs of 17 to 20 qubits, the sizes of the devices, with a measurement and a reset before other steps."""
    n = F.col("n_nationkey") % 4 + 17
    chain = F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.format_string("cx q[%d],q[%d];", (k - 1).cast("int"), k.cast("int"))), " ")
    program = F.concat(F.lit("OPENQASM 2.0; qreg q["), n.cast("string"), F.lit("]; creg c["), n.cast("string"), F.lit("]; h q[0]; measure q[0] -> c[0]; reset q[0]; h q[0]; "), chain, F.lit(" measure q -> c;"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", program.alias("program"), F.lit(100).alias("shots"))
    return circuits.with_ideal(rows, "program", "shots", "n_nationkey", "native").drop("program")


@query("M6 M9 M11 M12 F16")
def gbt_tier_ablation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 110_000).alias("target"))
    li = splits.group_holdout(li.withColumn("l_orderkey", F.col("l_orderkey")), "l_orderkey", 42)
    tiers = {"Tier 3": ["l_quantity"], "Tier 2a": ["l_discount", "l_tax"], "Tier 2b": ["l_quantity", "l_discount", "l_tax"]}
    rows = models.ablation(li, tiers, "target", "Tier 3", kind="boosted", trees=2, rate=0.5)
    return spark.createDataFrame(rows, "tier string, r2 double, mae double, rmse double, n_train long, n_test long, n_features long, delta_r2 double")


@query("M7")
def leave_one_device_out(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("device"), "l_quantity", "l_tax", (F.col("l_extendedprice") / 110_000).alias("target"))
    rows = models.leave_one_device_out(li, "device", ["l_quantity", "l_tax"], "target", "forest", numTrees=5, maxDepth=4)
    return spark.createDataFrame(rows, "test_device string, r2 double, mae double, rmse double, n_train long, n_test long, n_features long")


_DAYS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS largest FROM events GROUP BY 1, 2"


@query("J15", f"SELECT * FROM ({_DAYS}) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def streaming_tumbling_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = windows.file_stream(spark, sf_dir, "events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = windows.drain(windows.tumbling(events, "ts", "event_type", "value", "1 day"), scratch(spark, "tumbling"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "least", "largest")


@query("J15", _DAYS)
def streaming_windows_flushed(spark, sf_dir):
    """All windows of a finished table: those that the stream has written, and those that it still holds at its end."""
    source = table(spark, sf_dir, "events")
    typed = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = typed(windows.file_stream(spark, sf_dir, "events.parquet", source.schema))
    done = windows.drain(windows.tumbling(stream, "ts", "event_type", "value", "1 day"), scratch(spark, "flushed"))
    out = done.unionByName(windows.unfinished(typed(source), "ts", "event_type", "value", "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "least", "largest")
