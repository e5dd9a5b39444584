"""The network: gradients against differences, equal results for any partitions, and what a line can't learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import linear, network
from telemill.operators.stats import regression_scores


def test_gradient_equals_differences():
    s = network.Settings(embedding=3, hidden=7, seed=4)
    w = network.initial(4, 2, s)
    rnd = np.random.default_rng(1)
    x, device, y = rnd.normal(size=(9, 4)), rnd.integers(0, 3, 9), rnd.random(9)
    _, g = network.gradient(w, x, device, y)
    for name in w:
        for at in list(np.ndindex(w[name].shape))[:12]:
            before = w[name][at]
            sides = []
            for h in (1e-6, -1e-6):
                w[name][at] = before + h
                sides.append(network.gradient(w, x, device, y)[0])
            w[name][at] = before
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-7)
    assert np.array_equal(network.flat(network.shaped(network.flat(w), w)), network.flat(w))


def planted(spark, n=6000):
    a, b = F.rand(3) * 2 - 1, F.rand(4) * 2 - 1
    df = spark.range(n).select("id", a.alias("a"), b.alias("b"), F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))).alias("device"))
    shift = F.when(F.col("device") == "d1", 0.3).otherwise(0.0)
    df = df.withColumn("y", F.lit(0.1) + 0.5 * (F.col("a") * F.col("b") > 0).cast("double") + shift)
    return df.withColumn("a", F.when(F.col("id") % 17 > 0, F.col("a")))


def test_equal_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 256)
    df, s = planted(spark, 2000).cache(), network.Settings(hidden=16, epochs=2, batch=512)
    nets = [network.fit(df.repartition(n), ["a", "b"], "device", "y", ["id"], s) for n in (1, 6)]
    assert nets[0].losses == nets[1].losses
    assert np.array_equal(network.flat(nets[0].weights), network.flat(nets[1].weights))


def test_learns_what_a_line_cannot(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 512)
    df = planted(spark).withColumn("is_test", F.col("id") % 5 == 0).cache()
    net = network.fit(df.where("not is_test"), ["a", "b"], "device", "y", ["id"], network.Settings(hidden=32, epochs=25, batch=512, rate=0.01))
    got = regression_scores(df.where("is_test").withColumn("p", net.prediction()), "y", "p").first()
    (line,) = linear.scores(df, "y", [linear.Case(~F.col("is_test"), F.col("is_test"), ["a", "b"])])
    assert net.devices == ["d0", "d1", "d2"] and got.n == 1200
    assert got.r2 > 0.8 > 0.3 > line.r2 and net.losses[-1] < net.losses[0]


def test_awkward_tables(spark):
    df = planted(spark, 40)
    s = network.Settings(hidden=4, epochs=1)
    empty = network.fit(df.where("false"), ["a", "b"], "device", "y", ["id"], s)
    assert df.withColumn("p", empty.prediction()).where("p is null or isnan(p)").count() == 0
    nothing = df.withColumns({"a": F.lit(None), "y": F.when(F.col("id") > 20, F.col("y"))})
    net = network.fit(nothing, ["a", "b"], "device", "y", ["id"], s)
    assert df.withColumn("device", F.lit("new")).withColumn("p", net.prediction()).where("p between 0 and 1").count() == 40
    with pytest.raises(ValueError, match="embedding"):
        network.MOST_DEVICES, most = 2, network.MOST_DEVICES
        try:
            network.fit(df, ["a"], "device", "y", ["id"], s)
        finally:
            network.MOST_DEVICES = most


def test_a_step_runs_only_the_partitions_of_its_batch(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 64)
    monkeypatch.setattr(network, "MOST_PARTS", 20)
    s = network.Settings(hidden=4)
    net = network.prepared(planted(spark, 2000), ["a", "b"], "device", s)
    packed, blocks = network.pack(net, planted(spark, 2000), "y", ["id"])
    held, seen, plain = network.Held.of(packed, blocks), [], type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda self, rdd, f, parts=None, *more: seen.append(parts) or plain(self, rdd, f, parts, *more))
    assert blocks == 32 and held.rows.getNumPartitions() == 16
    parts = [network.step_sums(held, [k], net.weights, 2) for k in range(blocks)]
    assert seen == [[k // 2] for k in range(blocks)]
    n, loss, g = network.step_sums(held, None, net.weights, 2)
    assert n == sum(p[0] for p in parts) == 2000 and np.allclose(g, sum(p[2] for p in parts)) and loss == pytest.approx(sum(p[1] for p in parts))


def test_training_is_one_job_and_equals_a_job_for_each_step(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 64)
    s, df = network.Settings(hidden=8, epochs=3, batch=256), planted(spark, 2000).cache()
    context = spark.sparkContext
    steps, plain = [], type(context).runJob
    monkeypatch.setattr(type(context), "runJob", lambda self, *a, **b: steps.append(1) or plain(self, *a, **b))
    one = network.fit(df, ["a", "b"], "device", "y", ["id"], s)
    assert network.at_once(context, 16) == 4 and not steps
    monkeypatch.setattr(network, "at_once", lambda *_: 0)
    many = network.fit(df, ["a", "b"], "device", "y", ["id"], s)
    assert len(steps) == 24
    assert one.losses == many.losses and np.array_equal(network.flat(one.weights), network.flat(many.weights))
