"""Sliding statistics against plain ones, with large offsets, ties and holes, and in linear time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import align


def plain(anchors, readings, seconds):
    out = {}
    for k, (g, t) in anchors.items():
        v = [x for h, s, x in readings if h == g and s is not None and t is not None and t - seconds <= s <= t]
        n = [x for x in v if x is not None]
        out[k] = (len(v), len(n), np.mean(n) if n else None, min(n, default=None), max(n, default=None), np.std(n, ddof=1) if len(n) > 1 else None)
    return out


def same(row, wanted, offset):
    _, n, mean, least, largest, sd = wanted
    assert (row.w__count, row.w__min, row.w__max) == (n, least, largest)
    assert row.w__mean == (None if mean is None else pytest.approx(mean, rel=1e-12))
    assert row.w__sd == (None if sd is None else pytest.approx(sd, rel=1e-6, abs=1e-12 if not offset else 1e-5))


@pytest.mark.parametrize("offset", [0.0, 1e9])
@pytest.mark.parametrize("seconds", [1, 7, 60, 5000])
def test_equal_plain_statistics(spark, offset, seconds):
    rnd = np.random.default_rng(seconds)
    rows = [(k, ["a", "b", None][rnd.integers(3)], None if k % 41 == 0 else int(rnd.integers(-200, 400)), None if k % 13 == 0 else offset + float(rnd.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, g string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    readings = [(g, s, v) for _, g, s, v in rows]
    wanted = plain({k: (g, s) for k, g, s, _ in rows}, readings, seconds)
    got = align.trailing_window(df, "g", "ts", "v", seconds)
    assert got.columns == [*df.columns, *[f"w__{x}" for x in align.STATISTICS]] and got.count() == len(rows)
    for r in got.collect():
        same(r, wanted[r.k], offset)
    anchors = df.where("k % 3 = 0").select("g", "k", F.col("ts").alias("at"))
    got = {r.k: r for r in align.window_statistics(anchors, df, ["g"], "k", "at", "ts", "v", seconds).collect()}
    there = {k for k, g, s, _ in rows if k % 3 == 0 and g is not None and s is not None and wanted[k][0]}
    assert set(got) == there
    for k in there:
        same(got[k], wanted[k], offset)


def test_repeated_anchors_stay_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0)], "g string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.w__count for r in align.window_statistics(df.withColumn("k", F.lit(1)), df, ["g"], "k", "ts", "ts", "v", 9).collect()] == [2, 2]
    assert align.trailing_window(df.where("false"), "g", "ts", "v", 9).collect() == []


def test_time_grows_with_the_rows(spark):
    """One series, all rows within one window: twice the rows take about twice the time, not four times."""

    def seconds(n):
        df = spark.range(n).select(F.lit("a").alias("g"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.col("id") % 97).cast("double").alias("v"))
        began = time.perf_counter()
        align.trailing_window(df, "g", "ts", "v", 3600).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(20_000)
    assert min(seconds(160_000) for _ in range(2)) < 4 * min(seconds(40_000) for _ in range(2)) + 1
