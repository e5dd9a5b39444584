import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import align, circuits, cohorts, columns, graphs, merge, models, quality, splits, stats
from telemill.sources import blobs, io
from telemill.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merge_keeps_left_rows_and_flags(spark):
    left = spark.createDataFrame([("1 ", "a"), ("2", "b"), (None, "c")], "id string, status string")
    right = spark.createDataFrame([(1, 5.0, "z"), (1, 6.0, "y"), (None, 7.0, "x")], "rid int, v double, status string")
    out = merge.merge_sensors(left, right, "id", "rid", [F.col("v")])
    assert rows(out.select("status", "v", "sensor_merge_found"), "status") == [("a", 5.0, True), ("b", None, False), ("c", None, False)]
    assert merge.merge_sensors(left, right, "id", "rid", keep="none").count() == 4
    assert rows(merge.merge_sensors(left, right, "id", "rid", [F.col("v")], "last").select("status", "v"), "status")[0] == ("a", 6.0)


def test_mean_or_first(spark):
    df = spark.createDataFrame([(1, 1, 2.0, None), (1, 2, 4.0, "b"), (1, 3, None, "c")], "id int, o int, v double, s string")
    assert rows(merge.mean_or_first(df, ["id"], F.col("o")).select("id", "v", "s"), "id") == [(1, 3.0, "b")]


def test_window_statistics_equals_trailing_window(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    a = align.window_statistics(df, df, ["k"], "id", "ts", "ts", "v", 300).select("id", F.round("w__mean", 9), "w__min", "w__max", "w__count")
    b = align.trailing_window(df, "k", "ts", "v", 300).select("id", F.round("w__mean", 9), "w__min", "w__max", "w__count")
    assert rows(a, "id") == rows(b, "id")


def test_latest_before_respects_age(spark):
    hour = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    anchors = spark.range(3).select("id", F.lit("d").alias("k"), F.element_at(F.array(hour(10), hour(58), hour(59)), F.col("id").cast("int") + 1).alias("ts"))
    samples = spark.range(1).select(F.lit("d").alias("k"), hour(10).alias("ts"), F.lit(3.0).alias("v"))
    assert rows(align.latest_before(anchors, samples, ["k"], "id", "ts", "ts", "v", 48).select("id", "v__asof", "v__age_hours"), "id") == [(0, 3.0, 0.0), (1, 3.0, 48.0), (2, None, None)]


@pytest.mark.parametrize(("values", "ok"), [({"logical_dag_ok": "False", "logical_depth": "nan", "hellinger_logical": "0.2"}, True), ({"logical_dag_ok": "no", "logical_sim_status": "FAILED"}, False), ({"hellinger_logical": "inf"}, True), ({"hellinger_logical": "nan"}, False), ({"logical_depth": "<NA>"}, False)])
def test_availability(spark, values, ok):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    assert (df.where(quality.side_available(df, [*values, "absent"])).count() == 1) is ok


def test_degenerate_columns_and_coverage(spark):
    df = spark.range(300).select("id", F.lit(1).alias("c"), F.lit(None).cast("double").alias("a__mean"), F.col("id").cast("double").alias("a__max"), F.when(F.col("id") == 0, 1).when(F.col("id") == 1, 2).alias("rare"))
    assert quality.degenerate_columns(df, ["id", "c", "a__mean", "a__max", "rare"]) == [("c", "constant"), ("rare", "sparse")]
    assert quality.covered_columns(df, ["rare", "absent", "a__max", "a__mean"], always=["a__mean"]) == ["a__max", "a__mean"]


def test_contract_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (4, None)], "id int, h double")
    assert rows(quality.contract(df, {"h": F.col("h").between(0, 1)}), "check") == [("h", 1, False)]
    assert quality.dense_ids(df, "id").first().ok is False and quality.unique(df, "id").first().ok is True
    assert quality.incomplete_channels(["a__mean", "a__min", "a__max", "a__sd", "b__value", "c__mean"]) == ["c"]


def test_carried_forward(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("channel"), F.lit(1).alias("w__count"), F.col("id").alias("w__min"), F.col("id").alias("w__max"))
    assert quality.carried_forward(df, "channel", "w").first().carried_forward is True
    windows_ = df.withColumns({"w__count": F.lit(3), "w__max": F.col("w__min") + 1})
    assert quality.carried_forward(windows_, "channel", "w").first().carried_forward is False
    assert quality.carried_forward(df.where("false"), "channel", "w").first().carried_forward is False


def test_column_rules():
    assert columns.decide(["hellinger_native", "job_id", "a__mean", "a__count", "native_depth"]) == [
        ("hellinger_native", "target", "distance to the ideal distribution"), ("job_id", "id", "identifier"), ("a__mean", "feature", "sensor channel"), ("a__count", "drop", "bookkeeping of a window"), ("native_depth", "feature", "program structure"),
    ]
    with pytest.raises(ValueError, match="no rule"):
        columns.decide(["???"])
    assert columns.drops(["a", "b", "c"], ["b", "x"], keep=["c"]) == (["b"], ["x"], ["a", "c"])
    with pytest.raises(ValueError, match="another device"):
        columns.check_no_leakage("superconducting", ["ion_lab_t"], ["ion_lab_t", "sc_x"])
    with pytest.raises(ValueError, match="metadata"):
        columns.check_no_metadata(["status"])
    assert columns.device_columns(["sc_a", "sc_cal_q01_t1", "ion_b"], "superconducting") == (["sc_a"], ["sc_cal_q01_t1"])
    assert len(columns.TIER3) == 21 and len(columns.TIER1) == 22


def test_forward_cut_weighs_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a", 1), ("b", 5)], "job string, s int").withColumn("ts", F.timestamp_seconds("s"))
    out = splits.forward_split(df, "job", "ts")
    assert out.first().cut == pytest.approx(1.8) and out.where("is_test").count() == 1


def test_group_splits(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"))
    out = splits.group_holdout(df, "g", 7).groupBy("g").agg(F.count_distinct("is_test").alias("n"), F.first("is_test").alias("t"))
    assert out.where("n > 1").count() == 0 and out.where("t").count() == math.ceil(0.2 * 37)
    hashes = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert splits._nth_hash(hashes, 700, 5) == sorted(r.h for r in hashes.collect())[699]
    assert splits.group_holdout(df.where("false"), "g", 7).count() == 0
    assert splits.group_holdout_exact(spark.range(11), "id", 42).where("is_test").count() == 3
    rows = spark.range(10).select(F.explode(F.sequence(F.lit(0), "id")).alias("x"), "id")
    assert {r.fold for r in splits.group_folds(rows, "id").collect()} == set(range(5))


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, p double")
    r = stats.regression_scores(df, "y", "p").first()
    assert (r.r2, r.mae) == (pytest.approx(0.75), pytest.approx(1 / 3))
    c = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    s = stats.classification_scores(c, "t", "p", [0, 1, 2]).first()
    assert s.accuracy == 0.5 and s.f1_2 == 0.0 and s.macro_f1 == pytest.approx((2 / 3 + 0.5) / 3)


def test_correlation_of_constants_is_null(spark):
    df = spark.range(5).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert df.agg(stats.correlation(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (9.0,)], "x double")
    assert rows(stats.histogram(df, "x", [0.0, 1.0, 2.0]).select("bin", "n"), "bin") == [(0, 2), (1, 3)]


def test_funnel_counts(spark):
    df = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 86400 * 31).alias("ts"))
    out = rows(cohorts.funnel(df, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 5)], "ts").select("step", "rows", "removed", "share"), "step")
    assert out == [(0, 10, 0, 100.0), (1, 5, 5, 50.0), (2, 3, 2, 30.0)]


def test_graph_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    out = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    got = dict(rows(out, "node"))
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 150)} == {100}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


BELL = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[2]; creg c[2]; h q[0]; cx q[0],q[1]; barrier q; measure q -> c;'


def test_program_structure():
    s = circuits.structure(circuits.parse(BELL))
    assert (s["n_qubits"], s["depth"], s["size"], s["n_1q_gates"], s["n_2q_gates"], s["n_measure"], s["connectedness"], s["component_count"]) == (2, 3, 4, 3, 2, 2, 1.0, 1)
    assert circuits.component_count([(0, 1), (2, 3)]) == 2
    three = circuits.parse("OPENQASM 3.0; qubit[3] q; bit[3] c; x q[0]; c = measure q;")
    assert three.syntax == "qasm3" and circuits.structure(three)["liveliness"] == 1.0
    assert circuits.canonical(circuits.parse(circuits.canonical(three))) == circuits.canonical(three)


@pytest.mark.parametrize("text", [None, "", "gASxyz", '["a"]', "qreg q[1]; foo q[0];", "qreg q[1]; h q[3];", "qreg q[2]; cx q[0],q[0];", "hello world;", "qreg q[1]; rx(__import__('os')) q[0];"])
def test_bad_programs_are_refused(text):
    with pytest.raises(circuits.ProgramError):
        circuits.parse(text)


def test_ideal_probabilities():
    assert circuits.probabilities(circuits.parse(BELL)) == {"00": pytest.approx(0.5), "11": pytest.approx(0.5)}
    defined = "qreg q[2]; creg c[2]; gate foo(a) x,y { rx(a) x; cx x,y; } foo(pi) q[0],q[1]; measure q -> c;"
    assert circuits.probabilities(circuits.parse(defined)) == {"11": pytest.approx(1.0)}
    assert circuits.probabilities(circuits.parse("qreg q[3]; creg c[3]; x q[0]; x q[1]; ccx q[0],q[1],q[2]; measure q -> c;")) == {"111": pytest.approx(1.0)}
    assert sum(circuits.sample(circuits.parse(BELL), 100, circuits.row_seed(42, "P_0", "logical")).values()) == 100


def test_wide_programs_and_steps_after_measurements():
    run = lambda text: circuits.probabilities(circuits.parse(text))
    half = pytest.approx(0.5)
    chain = " ".join(f"cx q[{k}],q[{k + 1}];" for k in range(19))
    ghz = f"qreg q[20]; creg c[20]; h q[0]; {chain} measure q -> c;"
    assert run(ghz) == {"0" * 20: half, "1" * 20: half}
    assert set(circuits.sample(circuits.parse(ghz), 100, 1)) == {"0" * 20, "1" * 20}
    assert run("qreg q[70]; creg c[70]; x q[69]; measure q -> c;") == {"1" + "0" * 69: pytest.approx(1.0)}
    assert sum(circuits.sample(circuits.parse("qreg q[18]; creg c[18]; h q; measure q -> c;"), 50, 1).values()) == 50
    assert run("qreg q[1]; creg c[2]; h q[0]; measure q[0] -> c[0]; x q[0]; measure q[0] -> c[1];") == {"01": half, "10": half}
    assert run("qreg q[2]; creg c[2]; h q[0]; cx q[0],q[1]; reset q[0]; measure q -> c;") == {"00": half, "10": half}
    assert run("qreg q[1]; creg c[1]; x q[0]; reset q[0]; x q[0]; measure q -> c;") == {"1": pytest.approx(1.0)}
    once = "qreg q[2]; creg a[1]; creg b[1]; h q[0]; measure q[0] -> a[0]; if(a==1) x q[1]; measure q[1] -> b[0];"
    assert run(once) == run(circuits.canonical(circuits.parse(once))) == {"00": half, "11": half}
    drawn = circuits.sample(circuits.parse(once), 1000, 3)
    assert set(drawn) == {"00", "11"} and sum(drawn.values()) == 1000 and 400 < drawn["00"] < 600
    with pytest.raises(circuits.ProgramError):
        run("qreg q[1]; creg c[1]; if(c>0) x q[0]; measure q -> c;")


def test_structure_and_simulation_as_columns(spark):
    df = spark.createDataFrame([("a", BELL, "100"), ("b", "junk", "0"), ("c", None, None)], "id string, t string, shots string")
    out = {r.id: r for r in circuits.with_structure(df, "t", "s").collect()}
    assert out["a"].s.depth == 3.0 and out["b"].s.parse_ok is False and out["c"].s is None
    sim = {r.id: r for r in circuits.with_ideal(df, "t", "shots", "id", "logical").collect()}
    assert sim["a"].logical_sim_status == "SUCCESS" and sim["b"].logical_sim_status == "FAILED" and sim["c"].ideal_result_logical is None


def test_blob_store(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (" ",)], "t string")
    path = str(tmp_path / "blobs")
    blobs.insert_ignore(spark, blobs.blobs(df, "t", "native"), path)
    blobs.insert_ignore(spark, blobs.blobs(df, "t", "native"), path)
    assert spark.read.parquet(path).count() == 2
    ref = spark.range(1).select(blobs.reference("native", F.lit("y")).alias("r")).first().r
    assert blobs.load(spark, path, ref) == "y" and blobs.load(spark, path, "native:0") is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "x int, y string, z void")
    for fmt in ("csv", "parquet", "json"):
        path = str(tmp_path / f"t.{fmt}")
        io.write(df, path)
        assert io.read(spark, path).select("y").first().y == "a"
    assert io.column_names(spark, str(tmp_path / "t.parquet")) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="missing columns"):
        io.read(spark, str(tmp_path / "t.parquet"), columns=["nope"])
    io.write(df.where("false").select("x"), str(tmp_path / "e.parquet"), compression="none")
    assert io.read(spark, str(tmp_path / "e.parquet")).columns == ["x"]
    names = tmp_path / "names.txt"
    names.write_text("a # first\n\n#x\nb\na\n")
    assert io.name_list(spark, str(names)) == ["a", "b"]


def test_manifests_and_selectors():
    m = '{"sensor_categories": {"cryo": {"sensors": {"a/b": {}, "a/c": {"enabled": false}}}}, "qubits": {"QB1": {"metrics": {"t1": {}}}}}'
    assert [(c["path"], c["kind"], c["category"]) for c in io.manifest_channels(m)] == [("a/b", "sensor", "cryo"), ("QB1/t1", "qubit", None)]
    with pytest.raises(ValueError, match="nothing"):
        io.manifest_channels("{}")
    assert io.select_value('{"a": {"b": [1, 2]}}', "a.b.1") == 2
    assert io.select_value("k,v\nx,1\ny,2\n", "v|k=y") == 2.0
    assert "| 1.5 |" in io.markdown_table(["a"], [(1.5,)])


def test_models(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).cast("double").alias("z"), ((F.col("id") % 20) / 20.0).alias("h"))
    split = splits.group_holdout(df, "id", 42)
    got = {r["tier"]: r for r in models.ablation(split, {"base": ["z"], "full": ["x", "z"]}, "h", "base", maxIter=5, maxDepth=3)}
    assert got["base"]["delta_r2"] == 0.0 and got["full"]["r2"] > 0.8
    _, m = models.fit_and_score(split.where("not is_test"), split.where("is_test"), ["x"], "h", "linear")
    assert m.r2 == pytest.approx(1.0)


def test_streaming_interval_join(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 2).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    r = s.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    joined = windows.windows_before(s.select("id", "k", "ts"), r, "k", "ts", "rts", 120).select("id", "rid")
    out = windows.drain(joined, str(tmp_path / "out"))
    expected = {(a, b) for a in range(20) for b in range(20) if a % 2 == b % 2 and 0 <= (a - b) * 60 <= 120}
    assert {tuple(x) for x in out.where("rid is not null").collect()} == expected


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_equal_sorted_values(spark, n):
    from telemill.operators.quantiles import exact_quantiles, group_quantiles

    values = spark.range(n).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 101) / 7.0).otherwise(F.lit(1e6)).alias("x"))
    df = values.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(None).cast("double").alias("x")))
    points = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]
    plain = np.array([r.x for r in values.collect()])
    assert exact_quantiles(df, "x", points) == pytest.approx(np.quantile(plain, points).tolist())
    assert exact_quantiles(df.where("false"), "x", [0.5]) == [None]
    got = {r.g: r.quantiles for r in group_quantiles(df, "x", points, ["g"]).collect()}
    groups = {}
    for r in values.collect():
        groups.setdefault(r.g, []).append(r.x)
    assert set(got) == set(groups) and all(got[g] == pytest.approx(np.quantile(v, points).tolist()) for g, v in groups.items())


def test_quantiles_of_one_large_skewed_group(spark):
    from telemill.operators.quantiles import group_quantiles

    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.exp(F.col("id") % 2003 / 40.0)).alias("x"), F.lit(None).cast("string").alias("g"))
    plain = np.array([r.x for r in df.select("x").collect()])
    (r,) = group_quantiles(df, "x", [0.1, 0.5, 0.999], ["g"]).collect()
    assert r.g is None and r.quantiles == pytest.approx(np.quantile(plain, [0.1, 0.5, 0.999]).tolist())


def test_rank_correlation_equals_plain_ranks(spark):
    import pandas as pd

    df = spark.range(400).select((F.col("id") % 3).alias("g"), (F.col("id") * 17 % 41).cast("double").alias("x"), (F.col("id") * F.col("id") % 59).cast("double").alias("y"))
    frame = pd.DataFrame([r.asDict() for r in df.collect()])
    want = {g: (len(f), f.x.rank().corr(f.y.rank())) for g, f in frame.groupby("g")}
    got = {r.g: (r.n, r.rho) for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert set(got) == set(want) and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1]) for g in want)


def test_tasks_of_connectedness_stay_small(spark, monkeypatch):
    """Partitions grow with the rows, and what is dealt by group isn't shuffled again."""
    monkeypatch.setattr(graphs, "TASK_ROWS", 100)
    df = graphs.dealt(spark.range(1000).select((F.col("id") % 50).alias("g"), (F.col("id") % 7).alias("u"), (F.col("id") % 3).alias("v")), "g")
    assert df.rdd.getNumPartitions() == 10
    out = graphs.connectedness(df, ["g"], "u", "v")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    pairs = {g: {frozenset((k % 7, k % 3)) for k in range(g, 1000, 50)} for g in range(50)}
    assert {r.g: (r.nodes, r.edges) for r in out.collect()} == {g: (len(frozenset().union(*p)), sum(len(x) == 2 for x in p)) for g, p in pairs.items()}


def test_equal_statements_are_read_once(monkeypatch):
    seen, plain = [], circuits._Parser.statement
    monkeypatch.setattr(circuits._Parser, "statement", lambda self, text: seen.append(text) or plain(self, text))
    p = circuits.parse("qreg q[2]; creg c[2];" + " h q[0]; cx q[0],q[1]; if (c==1) x q[1];" * 500 + " qreg r[2]; h q[0]; measure q -> c;")
    assert len(seen) < 20 and len(p.steps) == 1503
    assert circuits.structure(p)["depth"] == circuits.depth_of(p) and circuits.structure(p)["n_2q_gates"] == 500
    assert [s.condition for s in p.steps[:6]] == [(), (), ((0, 1), (1, 0))] * 2


def test_remembered_programs_are_bounded(monkeypatch):
    monkeypatch.setattr(circuits, "MOST_HELD", 5000)
    monkeypatch.setattr(circuits, "_held", {})
    monkeypatch.setattr(circuits, "_held_size", 0)
    for k in range(200):
        got = circuits.remembered("qreg q[1];" + " x q[0];" * (k % 60), ("depth", "canonical"))
        assert got == circuits.described("qreg q[1];" + " x q[0];" * (k % 60), ("depth", "canonical")) and got[0] == k % 60
        assert sum(len(t) + len(c) for (t, _), (_, c) in circuits._held.items()) <= 5000


def test_remembered_programs_are_bounded_in_bytes(monkeypatch):
    """Wide characters take up to four bytes, and each number and tuple takes its own."""
    import sys

    monkeypatch.setattr(circuits, "MOST_HELD", 20_000)
    monkeypatch.setattr(circuits, "_held", {})
    monkeypatch.setattr(circuits, "_held_size", 0)
    most = 0
    for k in range(300):
        text = f"qreg q[2]; // {'\U0001d11e' * (k % 40)}{k}\n" + " h q[0];" * k
        assert circuits.remembered(text, ("size", "twoq_ratio", "parse_ok")) == (k, 0 if k else None, True)
        held = [x for key, found in circuits._held.items() for x in (key, key[0], found, *found)]
        assert sum(map(sys.getsizeof, held)) <= 20_000
        most = max(most, len(circuits._held))
    assert most > 10
