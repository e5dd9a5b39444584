"""Models: preparation, splits, cross-validation, ablations, robustness, class shifts and importance.

A straight line has a closed form, so the drivers that take any model have oracles here on linear ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions.distributions import distance_class
from telemill.operators import align, boosting, explain, models, splits, stats

from .catalog import query, table

_LINES = "l_orderkey, l_linenumber, l_linestatus AS device, l_returnflag AS flag, l_quantity AS x, l_tax AS z, l_extendedprice / 110000 AS y"
#: Scores of a straight line on test rows: needs rows p(k, y, q, n_train) with predictions q.
_SCORES = "round(1 - sum((y - q) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(y - q)), 4) AS mae, round(sqrt(avg((y - q) ** 2)), 4) AS rmse, count(*) AS n_test"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("device"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("z"), (F.col("l_extendedprice") / 110_000).alias("y"))


@query(
    "M5 P18 H2",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS quantity, l_discount * 8 AS hellinger, CASE WHEN l_discount * 8 < 0.3 THEN 0 WHEN l_discount * 8 < 0.6 THEN 1 ELSE 2 END AS target_class FROM lineitem WHERE l_linestatus <> 'F'",
)
def frame_preparation(spark, sf_dir):
    """Numbers from text, rows without a target left out, classes; a metadata column among the features is refused."""
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_returnflag") == "R", " nan ").otherwise(F.col("l_quantity").cast("string"))
    target = F.when(F.col("l_linestatus") == "F", "N/A").otherwise((F.col("l_discount") * 8).cast("string"))
    rows = li.select("l_orderkey", "l_linenumber", text.alias("quantity"), target.alias("hellinger"))
    try:
        models.prepare(rows, ["quantity", "job_id"], "hellinger")
    except ValueError:
        return models.prepare(rows, ["quantity"], "hellinger").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    raise AssertionError("metadata was accepted as a feature")


@query(
    "M10 A32 H10",
    f"WITH l AS (SELECT {_LINES}, l_orderkey % 3 AS fold FROM lineitem WHERE l_orderkey % 5 <> 0), k AS (SELECT unnest([0, 1, 2]) AS k), f AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n_train FROM l JOIN k ON fold <> k GROUP BY 1), p AS (SELECT k, y, a * x + b AS q, n_train FROM l JOIN f ON fold = k) SELECT k::BIGINT AS fold, {_SCORES}, max(n_train) AS n_train FROM p GROUP BY k",
)
def cross_validation(spark, sf_dir):
    """Three folds of the training orders; a fifth of all orders isn't looked at."""
    train = _lines(spark, sf_dir).where("l_orderkey % 5 != 0").withColumn("fold", F.col("l_orderkey") % 3)
    rows = models.cross_validated(train, "fold", 3, ["x"], "y", "linear")
    return spark.createDataFrame([{k: v for k, v in r.items() if k != "n_features"} for r in rows], "fold long, r2 double, mae double, rmse double, n_test long, n_train long")


_REPEATS = (
    f"WITH l AS (SELECT {_LINES} FROM lineitem), s AS (SELECT unnest([42, 7]) AS seed), o AS (SELECT DISTINCT device, l_orderkey FROM l),"
    " g AS (SELECT seed, device, l_orderkey, row_number() OVER (PARTITION BY seed, device ORDER BY sha256(l_orderkey::VARCHAR || ':' || seed)) <= ceil(0.2 * count(*) OVER (PARTITION BY seed, device)) AS test FROM o, s),"
    " r AS (SELECT seed, device, test, x, z, y FROM l JOIN g USING (device, l_orderkey)),"
    " f AS (SELECT seed, device, regr_slope(y, x) AS ax, regr_intercept(y, x) AS bx, regr_slope(y, z) AS az, regr_intercept(y, z) AS bz FROM r WHERE NOT test GROUP BY ALL),"
    " t AS (SELECT seed, device, round(1 - sum((y - ax * x - bx) ** 2) / (var_pop(y) * count(*)), 4) AS rx, round(1 - sum((y - az * z - bz) ** 2) / (var_pop(y) * count(*)), 4) AS rz FROM r JOIN f USING (seed, device) WHERE test GROUP BY ALL)"
    " SELECT device, seed::BIGINT AS split_seed, 'Tier 3' AS tier, rz AS r2, 0::DOUBLE AS delta_r2 FROM t UNION ALL SELECT device, seed::BIGINT, 'Tier 2b', rx, round(rx - rz, 4) FROM t"
)


@query("M14 M3 M11 M12", _REPEATS)
def repeated_splits(spark, sf_dir):
    """Two tiers on each pool under each seed's split, all fitted together."""
    rows = splits.group_holdouts(_lines(spark, sf_dir), "l_orderkey", [42, 7], "device")
    found = models.repeated_linear(rows, (42, 7), {"Tier 3": ["z"], "Tier 2b": ["x"]}, "y", "Tier 3", F.col("device"), ["F", "O"])
    return spark.createDataFrame([(r["pool"], r["split_seed"], r["tier"], r["r2"], r["delta_r2"]) for r in found], "device string, split_seed long, tier string, r2 double, delta_r2 double")


@query(
    "M16 F15",
    f"WITH l AS (SELECT {_LINES} FROM lineitem), m AS (SELECT flag, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, flag LIMIT 1), r AS (SELECT l.*, l_orderkey % 5 = 0 AS test FROM l WHERE flag = (SELECT flag FROM m)), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r WHERE NOT test), p AS (SELECT y, a * x + b AS q FROM r, f WHERE test) SELECT (SELECT flag FROM m) AS bucket, (SELECT n FROM m) AS rows, {_SCORES}, 1 - sum((y - q) ** 2) / (var_pop(y) * count(*)) >= 0.85 AS robust FROM p",
)
def restricted_robustness(spark, sf_dir):
    """Whether a model holds (R2 of 0.85 or more) within the rows of the most frequent bucket."""
    rows = _lines(spark, sf_dir).withColumn("is_test", F.col("l_orderkey") % 5 == 0)
    r = models.robust_in_largest(rows, "flag", ["x"], "y", "linear")
    return spark.createDataFrame([(r["bucket"], r["rows"], r["r2"], r["mae"], r["rmse"], r["n_test"], r["robust"])], "bucket string, rows long, r2 double, mae double, rmse double, n_test long, robust boolean")


def _windows(hours):
    return f"w{hours} AS (SELECT event_id, value AS y, avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW) AS x FROM events)"


def _ablation_rows(minutes):
    h = minutes // 60
    return f"SELECT {minutes}::BIGINT AS window_min, (SELECT round(1 - sum((y - a * x - b) ** 2) / (var_pop(y) * count(*)), 4) FROM w{h}, (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM w{h} WHERE event_id % 5 <> 0) WHERE event_id % 5 = 0) AS r2"


@query("M17 P16 H15", f"WITH {_windows(2)}, {_windows(5)}, z AS (SELECT round(1 - sum((value - m) ** 2) / (var_pop(value) * count(*)), 4) AS base FROM events, (SELECT avg(value) AS m FROM events WHERE event_id % 5 <> 0) WHERE event_id % 5 = 0), r AS ({_ablation_rows(120)} UNION ALL {_ablation_rows(300)}) SELECT window_min, r2, round(r2 - base, 4) AS delta_r2 FROM r, z")
def window_ablation(spark, sf_dir):
    """Window lengths against each other, over the columns that all of them have; the base tier (a constant) is fitted once."""
    from telemill.sources.io import window_paths

    events = table(spark, sf_dir, "events").withColumns({"is_test": F.col("event_id") % 5 == 0, "base": F.lit(1.0)})
    frames = {}
    for minutes in window_paths(["300=b", "120=a"]):
        w = align.trailing_window(events, "event_type", "ts", "value", minutes * 60)
        only = {"w__sd": "extra"} if minutes == 300 else {}  # a column that the other length lacks
        frames[minutes] = w.select("is_test", "base", F.col("value").alias("y"), "w__mean", *[F.col(c).alias(n) for c, n in only.items()])
    rows = models.window_ablation(frames, ["base"], "y", "linear")
    return spark.createDataFrame([(r["window"], r["r2"], r["delta_r2"]) for r in rows], "window_min long, r2 double, delta_r2 double")


_CLASS = "CASE WHEN {0} < 0.3 THEN 0 WHEN {0} < 0.6 THEN 1 ELSE 2 END"


@query(
    "M22 D18",
    f"WITH l AS (SELECT {_LINES}, l_orderkey % 5 = 0 AS test FROM lineitem), f AS (SELECT regr_slope(y, x) AS ax, regr_intercept(y, x) AS bx, regr_slope(y, z) AS az, regr_intercept(y, z) AS bz FROM l WHERE NOT test), c AS (SELECT device, {_CLASS.format('(az * z + bz)')} AS a, {_CLASS.format('(ax * x + bx)')} AS b, {_CLASS.format('y')} AS t FROM l, f WHERE test) SELECT device, count(*) AS n, round(100 * avg((a <> b)::INT), 4) AS changed, round(100 * avg((b < a)::INT), 4) AS improved, round(100 * avg((b > a)::INT), 4) AS worsened, round(avg((a = t)::INT), 6) AS lower_accuracy, round(avg((b = t)::INT), 6) AS higher_accuracy FROM c GROUP BY 1",
)
def class_shift_of_tiers(spark, sf_dir):
    """Classes that two fitted tiers predict for the same test rows, and how they move."""
    rows = _lines(spark, sf_dir).withColumn("is_test", F.col("l_orderkey") % 5 == 0)
    out = models.class_shift(rows, ["z"], ["x"], "y", "linear").cache()
    moves = stats.transition_summary(out, "lower_class", "higher_class", ["device"])
    hits = out.groupBy("device").agg(*[F.round(F.avg((F.col(f"{t}_class") == F.col("target_class")).cast("double")), 6).alias(f"{t}_accuracy") for t in ("lower", "higher")])
    return moves.join(hits, "device").select("device", "n", *[F.round(c, 4).alias(c) for c in ("changed", "improved", "worsened")], "lower_accuracy", "higher_accuracy")


_SHIFTED = (
    f"WITH l AS (SELECT {_LINES}, l_orderkey % 5 = 0 AS test, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM l WHERE NOT test),"
    " h AS (SELECT *, sha256(id || ':42') AS h FROM l WHERE test), s AS (SELECT flag, y, x, coalesce(lead(x) OVER w, first_value(x) OVER w) AS sx FROM h WINDOW w AS (ORDER BY h, id))"
    " SELECT flag, 'x' AS feature, 'other' AS category, round(avg(abs(y - a * sx - b)) - avg(abs(y - a * x - b)), 6) AS importance, 1::BIGINT AS rank FROM s, f GROUP BY 1"
)


@query("A33", _SHIFTED)
def permutation_importance(spark, sf_dir):
    """How much each class's error grows if a feature is shuffled among the test rows."""
    rows = _lines(spark, sf_dir).withColumns({"is_test": F.col("l_orderkey") % 5 == 0, "id": F.concat_ws("-", *[F.col(f"l_{k}").cast("string") for k in ("orderkey", "linenumber", "partkey", "suppkey")])})
    train, test = rows.where("not is_test"), rows.where("is_test")
    model, _ = models.fit_and_score(train, test, ["x"], "y", "linear")
    out = models.permutation_importance(model, train, test, "id", ["x"], "y", 42, ["flag"])
    return out.select("flag", "feature", "category", F.round("importance", 6).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query("M1", "SELECT n_nationkey, n_nationkey IN (0, 8, 11, 16, 23) AS is_test FROM nation")
def exact_group_holdout(spark, sf_dir):
    """The seeded permutation of groups, as the usual library draws it."""
    return splits.group_holdout_exact(table(spark, sf_dir, "nation"), "n_nationkey", 42)


def _tier1(spark, sf_dir):
    """Order sizes as a target that structure tells: the order's total price by its lines' sums, with values left out."""
    li = table(spark, sf_dir, "lineitem")
    li = li.groupBy("l_orderkey").agg(*[F.round(F.sum(f"l_{c}"), 6).alias(c) for c in ("quantity", "extendedprice", "tax")], F.count(F.lit(1)).cast("double").alias("n_lines"), F.max("l_linestatus").alias("device"))
    held = F.when(F.col("l_orderkey") % 11 > 0, F.col("quantity"))
    return li.select("l_orderkey", "device", held.alias("quantity"), "n_lines", "tax", (F.col("extendedprice") / F.lit(1e6)).alias("y"), (F.col("l_orderkey") % 5 == 0).alias("is_test"))


_TIER1 = ["quantity", "n_lines", "tax"]


@query("M19 M6 M7 M8")
def tier1_models(spark, sf_dir):
    """Tier 1 by leaf-wise boosted trees, a forest grown to leaves of five rows, and a network with device embeddings."""
    rows = _tier1(spark, sf_dir).cache()
    train, test = rows.where("not is_test"), rows.where("is_test")
    settings = {"boosted": {"trees": 6, "rate": 0.4, "key": ["l_orderkey"]}, "full_forest": {"trees": 16, "key": ["l_orderkey"]}, "network": {"device": "device", "key": ["l_orderkey"], "epochs": 8, "batch": 32_768, "rate": 0.01, "hidden": 32}}
    out = [(kind, *models.fit_and_score(train, test, _TIER1, "y", kind, **s)[1].rounded().values()) for kind, s in settings.items()]
    rows.unpersist()
    return spark.createDataFrame(out, "model string, r2 double, mae double, rmse double, n_train long, n_test long, n_features long")


@query("M20 A33 M6")
def tree_shapley_importance(spark, sf_dir):
    """Mean absolute Shapley value of each feature of a boosted model, by device and class of the target, over all test rows."""
    rows = _tier1(spark, sf_dir).withColumn("class", distance_class(F.col("y")))
    model = boosting.fit(rows.where("not is_test"), _TIER1, "y", ["l_orderkey"], boosting.Settings(trees=4, rate=0.5))
    out = explain.importance(model, rows.where("is_test"), ["device", "class"])
    return out.select("device", "class", "feature", "category", F.round("mean_abs", 9).alias("mean_abs"), F.col("rank").cast("long").alias("rank"))


@query(
    "M13",
    f"WITH l AS (SELECT {_LINES}, l_orderkey % 5 = 0 AS test FROM lineitem), d AS (SELECT DISTINCT device AS test_device FROM l UNION ALL SELECT 'pooled'), f AS (SELECT test_device, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n_train FROM l, d WHERE CASE WHEN test_device = 'pooled' THEN NOT test ELSE device <> test_device END GROUP BY 1), p AS (SELECT test_device, y, a * x + b AS q, n_train FROM l, f WHERE CASE WHEN test_device = 'pooled' THEN test ELSE device = test_device END) SELECT test_device, {_SCORES}, max(n_train) AS n_train FROM p GROUP BY 1",
)
def device_transfer(spark, sf_dir):
    """Models of all other devices on each device, and a model of all on rows held out from all, fitted together."""
    rows = _lines(spark, sf_dir).withColumn("is_test", F.col("l_orderkey") % 5 == 0)
    out = models.device_transfer(rows, "device", ["x"], "y")
    out = [{k: v for k, v in r.items() if k != "n_features"} for r in out]
    return spark.createDataFrame(out, "test_device string, r2 double, mae double, rmse double, n_test long, n_train long")
