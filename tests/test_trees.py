"""Boosted trees against a one-machine version, their laws, and Shapley values against enumeration."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from telemill.operators import boosting, explain, trees
from telemill.operators.stats import regression_scores


def rows_of(spark, size="sf0.01"):
    li = spark.read.parquet(f"{DATA}/{size}/lineitem.parquet")
    x = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    y = F.when(F.col("l_returnflag") == "R", 3.0).otherwise(F.col("l_quantity") * F.col("l_tax")) + F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_tax").alias("z"), F.col("l_suppkey").cast("double").alias("s"), y.alias("y"))


def plain_tree(bins, g, s, scale, used):
    """Best-first growth, a leaf at a time: the same settings and ties as the distributed one."""

    def best(rows):
        found = None
        for f in used:
            counts = np.bincount(bins[f, rows], minlength=256)
            sums = np.array([g[rows][bins[f, rows] == b].sum() for b in range(256)], dtype=np.int64)
            got = boosting.best_split(counts, sums, s, scale)
            if got and (found is None or got[0] > found[1][0]):
                found = (f, got)
        return found

    leaves = [(np.arange(bins.shape[1]), 0)]
    heap, count, splits = [], itertools.count(), []

    def push(number):
        rows, depth = leaves[number]
        if depth < s.depth and len(rows) >= 2 * s.least and (b := best(rows)):
            heapq.heappush(heap, (-b[1][0], number, b))

    push(0)
    next(count)
    while heap and len(splits) < s.leaves - 1:
        gain, number, (f, (_, cut, missing_left, n, _)) = heapq.heappop(heap)
        rows, depth = leaves[number]
        b = bins[f, rows]
        left = np.where(b == trees.MISSING, missing_left, b <= cut)
        assert left.sum() == n
        splits.append((f, cut, missing_left, len(rows), round(-gain, 6)))
        for part in (rows[left], rows[~left]):
            leaves.append((part, depth + 1))
            push(len(leaves) - 1)
    return splits


@pytest.mark.parametrize("more", [{}, {"rows": 0.6, "columns": 0.7, "penalty": 2.0}])
def test_trees_equal_a_one_machine_version(spark, more):
    s = boosting.Settings(trees=3, leaves=20, depth=6, rate=0.3, bins=32, **more)
    df, features, key = rows_of(spark).where("l_orderkey % 6 = 0"), ["x", "z", "s"], ["l_orderkey", "l_linenumber"]
    model = boosting.fit(df, features, "y", key, s)
    local = df.withColumn("mark", F.xxhash64(*key)).toPandas()
    bins = trees.binned([local[c].to_numpy() for c in features], model.edges)
    y, now, mark = local["y"].to_numpy(), np.full(len(local), model.base), local["mark"].to_numpy().view(np.uint64)
    scale = boosting.STEPS / max(y.max() - model.base, model.base - y.min())
    for number, tree in enumerate(model.trees):
        use = boosting.chance(mark, s.seed * 100_003 + number) < s.rows
        g = np.rint((now - y) * scale).astype(np.int64)
        wanted = plain_tree(bins[:, use], g[use], s, scale, boosting.columns_of(features, number, s))
        inner = tree.left >= 0
        got = sorted(zip(tree.feature[inner].tolist(), tree.bin[inner].tolist(), tree.missing_left[inner].tolist(), tree.cover[inner].tolist(), strict=True))
        assert got == sorted(w[:4] for w in wanted)
        assert (tree.left < 0).sum() == len(wanted) + 1 and tree.cover[0] == use.sum()
        ends = tree.ends(bins[:, use])
        for leaf in np.unique(ends):
            assert tree.value[leaf] == pytest.approx(-s.rate * g[use][ends == leaf].sum() / scale / ((ends == leaf).sum() + s.penalty))
        now = now + tree(bins)
    assert len(model.trees) == 3


def test_equal_trees_for_any_partitions(spark):
    df, s = rows_of(spark).where("l_orderkey % 5 = 0"), boosting.Settings(trees=2, leaves=8, rows=0.8)
    models = [boosting.fit(df.repartition(n), ["x", "z"], "y", ["l_orderkey", "l_linenumber"], s) for n in (1, 7)]
    for a, b in zip(models[0].trees, models[1].trees, strict=True):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "bin", "left", "value", "cover", "missing_left"))


def test_missing_values_tell(spark):
    """The rows without x have the target 3, whatever else they hold; no imputed value could say so."""
    df = rows_of(spark)
    model = boosting.fit(df, ["x", "z"], "y", ["l_orderkey", "l_linenumber"], boosting.Settings(trees=12, leaves=16, rate=0.5))
    (score,) = regression_scores(df.withColumn("p", model.prediction()), "y", "p").collect()
    assert score.r2 > 0.97


def test_defined_results_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "k long, x double, y double")
    assert boosting.fit(empty, ["x"], "y", ["k"]).trees == []
    constant = spark.createDataFrame([(k, float(k), 4.0) for k in range(50)], "k long, x double, y double")
    model = boosting.fit(constant, ["x"], "y", ["k"])
    assert model.trees == [] and model.base == 4.0
    holes = spark.createDataFrame([(k, None if k % 3 else float("nan"), float(k % 2) if k % 5 else None) for k in range(200)], "k long, x double, y double")
    model = boosting.fit(holes, ["x"], "y", ["k"], boosting.Settings(trees=3))
    assert model.trees == [] and holes.withColumn("p", model.prediction()).where("p is null").count() == 0


def random_tree(rnd, features, depth):
    rows = []

    def grow(cover, level):
        k = len(rows)
        rows.append(None)
        if level == depth or cover < 2 or rnd.random() < 0.15:
            rows[k] = (-1, 0, False, -1, -1, rnd.normal(), cover)
        else:
            n = int(rnd.integers(1, cover))
            head = (int(rnd.integers(features)), int(rnd.integers(0, 5)), bool(rnd.integers(2)))
            a, b = grow(n, level + 1), grow(cover - n, level + 1)
            rows[k] = (*head, a, b, 0.0, cover)
        return k

    grow(5000, 0)
    return trees.Tree.of(rows)


def conditional(tree, bins, known, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        x = bins[tree.feature[node]]
        left = tree.missing_left[node] if x == trees.MISSING else x <= tree.bin[node]
        return conditional(tree, bins, known, a if left else b)
    return (tree.cover[a] * conditional(tree, bins, known, a) + tree.cover[b] * conditional(tree, bins, known, b)) / tree.cover[node]


@pytest.mark.parametrize(("features", "depth", "limit"), [(1, 3, 10), (4, 6, 10), (7, 8, 10), (7, 8, 2), (12, 9, 10)])
def test_shapley_values_equal_enumeration(monkeypatch, features, depth, limit):
    monkeypatch.setattr(explain, "TABLE", limit)
    rnd = np.random.default_rng(features * 100 + depth)
    model = trees.Ensemble([f"c{k}" for k in range(features)], [np.arange(5.0)] * features, 0.7, [random_tree(rnd, features, depth) for _ in range(2)])
    bins = rnd.choice([0, 1, 2, 3, 4, 5, trees.MISSING], size=(features, 5 if features < 12 else 1)).astype(np.uint8)
    got = explain.shapley(model, bins)
    subsets = [frozenset(c) for n in range(features + 1) for c in itertools.combinations(range(features), n)]
    for r in range(bins.shape[1]):
        worth = {s: sum(conditional(t, bins[:, r], s) for t in model.trees) for s in subsets}
        for j in range(features):
            wanted = sum(math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features) * (worth[s | {j}] - worth[s]) for s in subsets if j not in s)
            assert got[r, j] == pytest.approx(wanted, abs=1e-10)
        assert explain.expected(model) == pytest.approx(model.base + worth[frozenset()])


def test_shapley_values_add_up(spark):
    df = rows_of(spark)
    model = boosting.fit(df, ["x", "z", "s"], "y", ["l_orderkey", "l_linenumber"], boosting.Settings(trees=4, rate=0.3))
    gap = F.abs(F.col("p") - explain.expected(model) - F.col("s.f0") - F.col("s.f1") - F.col("s.f2"))
    assert df.select(model.prediction().alias("p"), explain.values(model).alias("s")).agg(F.max(gap)).first()[0] < 1e-9
    per_group = explain.importance(model, df.withColumn("k", F.col("l_linenumber") % 2), ["k"]).collect()
    wide = df.select((F.col("l_linenumber") % 2).alias("k"), *["x", "z", "s"]).toPandas()
    shap = np.abs(explain.shapley(model, model.binned([wide[c].to_numpy() for c in ("x", "z", "s")])))
    for r in per_group:
        assert r.mean_abs == pytest.approx(shap[(wide["k"] == r.k).to_numpy(), ["x", "z", "s"].index(r.feature)].mean())
    assert sorted(r["rank"] for r in per_group) == [1, 1, 2, 2, 3, 3]
