"""Many straight lines at once against plain least squares, and the number of jobs that they take."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from telemill.operators import linear, models, splits


def frame(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k in range(500):
        x, z = rnd.normal() + 1e6, rnd.normal() * 1e-3
        y = 2 * (x - 1e6) - 300 * z + rnd.normal() * 0.1 + (5 if k % 7 == 0 else 0)
        rows.append((k, None if k % 7 == 0 else x, float("nan") if k % 11 == 0 else z, 4.0, None if k % 50 == 0 else y, k % 3))
    return spark.createDataFrame(rows, "k int, x double, z double, c double, y double, fold int")


def plain(rows, train, test, features):
    """Least squares with the median for missing values and a column that marks them."""
    value = lambda r, f: np.nan if r[f] is None else r[f]
    some = [r for r in rows if r["y"] is not None]
    a, b = [r for r in some if train(r)], [r for r in some if test(r)]
    columns = []
    for f in features:
        v = np.array([value(r, f) for r in a])
        m = np.nanmedian(v)
        columns.append(lambda r, f=f, m=m: m if np.isnan(value(r, f)) else value(r, f))
        columns.append(lambda r, f=f: float(np.isnan(value(r, f))))
    matrix = lambda rs: np.array([[1.0, *[c(r) - (1e6 if i == 0 and features[0] == "x" else 0) for i, c in enumerate(columns)]] for r in rs])
    beta = np.linalg.lstsq(matrix(a), np.array([r["y"] for r in a]), rcond=None)[0]
    y, p = np.array([r["y"] for r in b]), matrix(b) @ beta
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), len(a), len(b)


def test_models_equal_plain_least_squares(spark):
    df = frame(spark)
    rows = [r.asDict() for r in df.collect()]
    features = [["x"], ["x", "z", "c"], ["z"]]
    cases = [linear.Case(F.col("fold") != k, F.col("fold") == k, f) for k in range(3) for f in features]
    got = linear.scores(df, "y", cases)
    wanted = [plain(rows, lambda r, k=k: r["fold"] != k, lambda r, k=k: r["fold"] == k, f) for k in range(3) for f in features]
    for g, w in zip(got, wanted, strict=True):
        assert (g.r2, g.mae, g.rmse, g.fit.n_train, g.n_test) == pytest.approx(w, rel=1e-6)


def test_rare_features_and_empty_parts(spark):
    df = frame(spark).withColumn("rare", F.when(F.col("k") < 5, 1.0))
    case = linear.Case(F.col("fold") == 0, F.lit(False), ["x", "rare"], 0.1)
    (s,) = linear.scores(df, "y", [case])
    assert s.fit.columns == ["x", "x__missing"] and (s.r2, s.mae, s.rmse, s.n_test) == (None, None, None, 0)
    (s,) = linear.scores(df, "y", [linear.Case(F.lit(False), F.lit(True), ["x"])])
    assert s.fit.n_train == 0 and s.r2 is None
    (s,) = linear.scores(df.where("false"), "y", [case])
    assert s.n_test == 0


def jobs(spark, f):
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        f()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_dont_grow_with_the_models(spark):
    df = frame(spark)
    few = jobs(spark, lambda: models.cross_validated(df, "fold", 2, ["x"], "y", "linear"))
    assert jobs(spark, lambda: models.cross_validated(df.withColumn("fold", F.col("k") % 12), "fold", 12, ["x", "z"], "y", "linear")) == few
    o = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").select("o_custkey", (F.col("o_totalprice") / 1e5).alias("y"), F.month("o_orderdate").cast("double").alias("x"))
    run = lambda seeds: models.repeated_linear(splits.group_holdouts(o, "o_custkey", seeds), seeds, {"a": ["x"]}, "y", "a", always=["x"])
    assert abs(jobs(spark, lambda: run([1])) - jobs(spark, lambda: run([1, 2, 3, 4, 5]))) <= 4


def test_holdouts_equal_those_of_each_seed(spark):
    df = spark.range(3000).select((F.col("id") % 701).alias("g"), F.when(F.col("id") % 701 < 300, "a").when(F.col("id") % 701 < 699, "b").alias("p"))
    df = df.unionByName(spark.createDataFrame([(None, "a")], "g long, p string"))
    both = splits.group_holdouts(df, "g", [42, 7], "p")
    for pool in ("a", "b", None):
        mine = both.where(F.col("p").eqNullSafe(F.lit(pool)))
        for seed in (42, 7):
            alone = splits.group_holdout(df.where(F.col("p").eqNullSafe(F.lit(pool))), "g", seed)
            assert {r.g for r in mine.where(f"is_test_{seed}").collect()} == {r.g for r in alone.where("is_test").collect()}
    assert both.where("g is null and (is_test_42 or is_test_7)").count() == 0
