"""Folds, hold-outs, hot groups and the ring shuffle against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.operators import models, splits


def greedy(sizes, k):
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        out[g] = load.index(min(load))
        load[out[g]] += n
    return out


def placed(histogram, k):
    """Folds of groups in order of size and rank, as the plan tells them."""
    out = []
    for size, parts in splits.fold_plan(histogram, k).items():
        for r in range(histogram[size]):
            begin, turn = [p for p in parts if p[0] <= r][-1]
            out.append((size, turn[(r - begin) % len(turn)]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.one_of(st.integers(1, 12), st.integers(1, 3000)), st.integers(1, 60), max_size=8), st.integers(2, 5))
def test_plan_is_the_greedy(histogram, k):
    load, wanted = [0] * k, []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            i = load.index(min(load))
            load[i] += size
            wanted.append((size, i))
    assert placed(histogram, k) == wanted


def test_folds_equal_the_greedy(spark):
    rnd = random.Random(2)
    sizes = {f"g{k}": rnd.choice([1, 1, 1, 2, 3, 40, 500]) for k in range(300)}
    df = spark.createDataFrame([(g, n) for g, n in sizes.items()], "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")))
    df = df.unionByName(df.where("false").union(spark.createDataFrame([(None, 1)], "g string, col int")))
    got = {r.g: (r.fold, r.rows) for r in splits.group_folds(df, "g", 4).collect()}
    assert got == {g: (f, sizes[g]) for g, f in greedy(sizes, 4).items()}
    assert splits.group_folds(df.where("false"), "g").collect() == []


def test_a_million_groups(spark):
    df = spark.range(1_300_000).select((F.col("id") % 1_000_000).alias("g"))
    load = {r.fold: (r.rows, r.groups) for r in splits.group_folds(df, "g").groupBy("fold").agg(F.sum("rows").alias("rows"), F.count("*").alias("groups")).collect()}
    assert {v[0] for v in load.values()} == {260_000} and sum(v[1] for v in load.values()) == 1_000_000


def test_exact_holdout(spark):
    df = spark.range(5000).select((F.col("id") % 731 * 3).alias("g")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("g")))
    for seed in (42, 7):
        picked = np.random.RandomState(seed).permutation(731)[: int(np.ceil(0.2 * 731))] * 3
        got = splits.group_holdout_exact(df, "g", seed).collect()
        assert len(got) == 731 and {r.g for r in got if r.is_test} == set(picked.tolist())


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_least_of_hot_groups(spark, monkeypatch, most):
    monkeypatch.setattr(splits, "MOST_ROWS", most)
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 4001).alias("v"), "id")
    rows = [r.asDict() for r in df.collect()]
    least = {}
    for r in rows:
        if r["v"] is not None:
            least[r["g"]] = min(least.get(r["g"], 1 << 40), r["v"])
    out = splits.with_group_least(df, "g", F.col("v"), "least")
    assert out.columns == ["g", "v", "id", "least"]
    assert {r.id: r.least for r in out.collect()} == {r["id"]: least.get(r["g"]) for r in rows}


def test_a_hot_group_is_dealt_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_ROWS", 1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("v"))
        parts = splits.with_group_least(df, "g", F.col("v"), "least").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 70_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("buckets", [1, 16, 256])
def test_shuffle_is_one_ring(spark, monkeypatch, buckets):
    monkeypatch.setattr(models, "LEAST_BUCKETS", buckets)
    df = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), F.col("id").alias("own"))
    got = models.shuffled(df, "k", ["v", "own"], 5)
    assert set(got.columns) == {"k", "v", "own", "v__shuffled", "own__shuffled"}
    after = {r.own: r.own__shuffled for r in got.collect()}
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == 600 and at == 0
    assert got.where("NOT (v__shuffled <=> if(own__shuffled % 7 > 0, own__shuffled, NULL))").count() == 0
    assert {r.own: r.own__shuffled for r in models.shuffled(df.repartition(7), "k", ["own"], 5).collect()} == after
    assert models.shuffled(df.where("false"), "k", ["v"], 5).collect() == []
