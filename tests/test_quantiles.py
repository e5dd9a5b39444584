"""Exact quantiles and ranks by cells, with a small bound so that groups of a few hundred rows count as large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import quantiles

POINTS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]


def values(kind, n, seed=1):
    rnd = np.random.default_rng(seed)
    x = {
        "normal": rnd.normal(size=n),
        "heavy": np.sign(rnd.normal(size=n)) * np.exp(rnd.normal(size=n) * 60),
        "ties": rnd.integers(-3, 4, size=n).astype(float),
        "close": 1e9 + rnd.integers(0, 50, size=n) * 1e-6,
        "one": np.full(n, 2.5),
        "tiny": rnd.integers(0, 1000, size=n) * 5e-324,
        "wide": np.concatenate((np.full(n // 2, -np.inf), rnd.normal(size=n - n // 2 - 5), np.full(5, np.inf))),
    }[kind]
    return x.tolist()


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "close", "one", "tiny", "wide"])
@pytest.mark.parametrize("most", [1 << 20, 40])
def test_quantiles_equal_sorted_values(spark, monkeypatch, kind, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    rows = [("a", x) for x in values(kind, 700)] + [(None, x) for x in values(kind, 333, 2)] + [("b", x) for x in values(kind, 12, 3)] + [("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = {g: np.sort([x for k, x in rows if k == g and x is not None]) for g in ("a", "b", None)}

    def wanted(v):
        place = [p * (len(v) - 1) for p in POINTS]
        return [v[int(a)] if v[int(a)] == v[int(np.ceil(a))] else (int(a) + 1 - a) * v[int(a)] + (a - int(a)) * v[int(np.ceil(a))] for a in place]

    got = {r.g: r.quantiles for r in quantiles.group_quantiles(df, "x", POINTS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(wanted(v), nan_ok=True)
    everything = np.sort([x for _, x in rows if x is not None])
    assert quantiles.exact_quantiles(df, "x", POINTS) == pytest.approx(wanted(everything), nan_ok=True)
    assert quantiles.exact_quantiles(df.where("false"), "x", [0.5]) == [None]
    assert quantiles.column_quantiles(df.withColumn("none", F.lit(None)), ["x", "none"], POINTS)[1] == [None] * len(POINTS)
    assert quantiles.column_quantiles(df, ["x"], POINTS)[0] == pytest.approx(wanted(everything), nan_ok=True)
    ranks = {(r.g, r.x): (r.n, r.before) for r in quantiles.ranked(df, "x", ["g"]).collect()}
    for g, v in groups.items():
        for x in np.unique(v):
            assert ranks.pop((g, x)) == (int((v == x).sum()), int((v < x).sum()))
    assert not ranks


def test_cells_follow_the_order_of_values(spark):
    x = sorted({*values("normal", 2000), *values("heavy", 3000), *values("tiny", 500), 0.0, float("inf"), float("-inf"), 1.7e308, -1.7e308})
    cells = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(quantiles.first_cell(F.col("x"))).collect()]
    assert cells == sorted(cells)


def test_a_group_of_many_rows_never_meets_in_one_buffer(spark, monkeypatch):
    """The plan of what is counted has no percentile: only cells of at most ``MOST`` rows are sorted."""
    monkeypatch.setattr(quantiles, "MOST", 1000)
    df = spark.range(60_000).select(F.lit("hot").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / 7.0).alias("x"))
    plain = np.sort([r.x for r in df.collect()])
    (r,) = quantiles.group_quantiles(df, "x", [0.1, 0.9], ["g"]).collect()
    assert r.quantiles == pytest.approx(np.quantile(plain, [0.1, 0.9]).tolist())
