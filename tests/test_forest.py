"""Forests: splits against plain search, leaves' sizes, upper and lower parts that fit together, held-out scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import forest, linear
from telemill.operators.stats import regression_scores


def plain(bins, y, w, ask, least):
    """A tree by recursion over rows, with the same ties."""

    def best(rows):
        n, s = w[rows].sum(), (w[rows] * y[rows]).sum()
        found = (1e-12, None)
        for f in range(len(bins)):
            for cut in np.unique(bins[f, rows])[:-1]:
                left = rows[bins[f, rows] <= cut]
                a, b = w[left].sum(), (w[left] * y[left]).sum()
                if a >= least and n - a >= least:
                    gain = b * b / a + (s - b) ** 2 / (n - a) - s * s / n
                    if gain > found[0] + 1e-12:
                        found = (gain, (f, cut))
        return found[1]

    def value(rows, x):
        split = best(rows)
        if split is None:
            return (w[rows] * y[rows]).sum() / w[rows].sum()
        f, cut = split
        side = bins[f, rows] <= cut
        return value(rows[side] if x[f] <= cut else rows[~side], x)

    return [value(np.arange(len(y)), ask[:, k]) for k in range(ask.shape[1])]


@pytest.mark.parametrize("least", [1, 5, 200])
def test_lower_parts_equal_plain_trees(least):
    rnd = np.random.default_rng(least)
    bins = rnd.integers(0, 40, size=(3, 150)).astype(np.uint8)
    y, w = bins[0] * 1.5 + rnd.normal(size=150) + (bins[1] > 20) * 9.0, rnd.integers(1, 4, 150)
    ask = rnd.integers(0, 40, size=(3, 25)).astype(np.uint8)
    assert forest.grown(bins, y, w, ask, least) == pytest.approx(plain(bins, y, w, ask, least))


def test_draws_have_mean_one():
    w = forest.drawn(np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and w.max() < 13


def frame(spark, n=6000):
    df = spark.range(n).select("id", (F.rand(5) * 10).alias("a"), (F.rand(6) * 10).alias("b"))
    y = F.floor(F.col("a")) % 2 * 4 + F.when(F.col("b") > 7, 3.0).otherwise(0.0)
    return df.withColumns({"y": y, "b": F.when(F.col("id") % 19 > 0, F.col("b")), "is_test": F.col("id") % 4 == 0}).cache()


def test_forest_learns_what_a_line_cannot(spark):
    df = frame(spark)
    s = forest.Settings(trees=6, local=700, at_once=4)
    out = forest.predict(df.where("not is_test"), df.where("is_test"), ["a", "b"], "y", ["id"], settings=s)
    assert out.columns == [*df.columns, "prediction"] and out.count() == 1500
    got = regression_scores(out, "y", "prediction").first()
    (line,) = linear.scores(df, "y", [linear.Case(~F.col("is_test"), F.col("is_test"), ["a", "b"])])
    assert got.r2 > 0.9 > 0.5 > line.r2
    again = forest.predict(df.where("not is_test").repartition(3), df.where("is_test"), ["a", "b"], "y", ["id"], settings=s)
    a, b = ({r.id: r.prediction for r in d.collect()} for d in (out, again))
    assert a == pytest.approx(b)


def test_small_and_empty_tables(spark):
    df = frame(spark, 40)
    none = forest.predict(df.where("false"), df, ["a"], "y", ["id"], settings=forest.Settings(trees=2))
    assert none.where("prediction is null").count() == 40
    few = forest.predict(df.limit(3), df, ["a", "b"], "y", ["id"], settings=forest.Settings(trees=40, least=1))
    assert few.where("prediction is null or isnan(prediction)").count() == 0 and few.count() == 40
    assert forest.predict(df, df.where("false"), ["a"], "y", ["id"], settings=forest.Settings(trees=2)).count() == 0


def test_rows_of_equal_bins_are_one_cell(spark, monkeypatch):
    df = spark.range(6000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumns({"y": F.col("a") * F.col("b") + F.rand(3), "is_test": F.col("id") % 4 == 0}).cache()
    train, test, s = df.where("not is_test"), df.where("is_test"), forest.Settings(trees=3, local=500)
    sizes, lower = [], forest._lower
    monkeypatch.setattr(forest, "_lower", lambda pieces, *a: sizes.append({r.kind: r.n for r in pieces.groupBy("kind").agg(F.sum("n").alias("n")).collect()}) or lower(pieces, *a))
    cells = {r.id: r.prediction for r in forest.predict(train, test, ["a", "b"], "y", ["id"], settings=s).collect()}
    tasks = df.rdd.getNumPartitions()
    assert sizes[0][1] == 3 * 35 and sizes[0][0] <= 3 * 35 * tasks and len(cells) == 1500
    monkeypatch.setattr(forest, "cells", lambda blocks, *_: blocks.selectExpr("*", "cast(null as binary) w", "cast(null as binary) steps"))
    rows = {r.id: r.prediction for r in forest.predict(train, test, ["a", "b"], "y", ["id"], settings=s).collect()}
    assert sizes[1][0] > 5000 and rows == pytest.approx(cells)
