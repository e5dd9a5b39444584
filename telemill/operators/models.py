"""Baseline models and ablations over feature tiers, on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.distributions import distance_class
from telemill.functions.nulls import number

from . import boosting, forest, linear, network
from .columns import check_no_metadata, common_columns, sensor_category
from .quality import covered_columns
from .quantiles import column_quantiles
from .stats import modal_value, regression_scores


@dataclass
class Metrics:
    r2: float | None
    mae: float | None
    rmse: float | None
    n_train: int
    n_test: int
    features: list[str] = field(default_factory=list)

    def rounded(self) -> dict:
        r = lambda x: None if x is None else round(x, 4)
        return {"r2": r(self.r2), "mae": r(self.mae), "rmse": r(self.rmse), "n_train": self.n_train, "n_test": self.n_test, "n_features": len(self.features)}


def prepare(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Numbers, no rows without a target, and the target's class."""
    check_no_metadata(features)
    out = df.withColumns({c: number(F.col(c)) for c in [*features, target]})
    return out.where(F.col(target).isNotNull()).withColumn("target_class", distance_class(F.col(target)))


def medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of the training rows; 0 for a feature without values."""
    return {c: q[0] or 0.0 for c, q in zip(features, column_quantiles(train, features, [0.5]), strict=True)}


def filled(df: DataFrame, features: list[str], values: dict[str, float]) -> DataFrame:
    """Missing values by training medians, and a column that tells which were missing."""
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in features}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in features})


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str = "gbt", seed: int = 42, **settings) -> tuple[object, Metrics]:
    """A model on training rows and its scores on test rows.

    Kinds: ``boosted`` (leaf-wise boosting, missing values as they are), ``network`` (with an embedding for each value of
    the setting ``device``), ``full_forest`` (grown to small leaves; it predicts at once, so there is no model to return),
    and of pyspark.ml ``gbt``, ``forest`` and ``linear``, with training medians for missing values.  The first three take
    a ``key``, columns that tell rows apart (all features and the target unless given).
    """
    if kind in ("boosted", "network", "full_forest"):
        settings = dict(settings)
        key = settings.pop("key", None) or [*features, target]
        if kind == "full_forest":
            scored = forest.predict(train, test.withColumn("__y", F.col(target).cast("double")), features, target, key, "__p", forest.Settings(seed=seed, **settings))
            row = regression_scores(scored, "__y", "__p").first()
            return None, Metrics(row.r2, row.mae, row.rmse, train.count(), row.n, features)
        if kind == "boosted":
            fitted = boosting.fit(train, features, target, key, boosting.Settings(seed=seed, **settings))
        else:
            device = settings.pop("device")
            fitted = network.fit(train, features, device, target, key, network.Settings(seed=seed, **settings))
        row = regression_scores(test.withColumns({"__y": F.col(target).cast("double"), "__p": fitted.prediction()}), "__y", "__p").first()
        return fitted, Metrics(row.r2, row.mae, row.rmse, train.count(), row.n, features)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    values = medians(train, features)
    columns = [*features, *[f"{c}__missing" for c in features]]
    assemble = VectorAssembler(inputCols=columns, outputCol="__x")
    ready = [assemble.transform(filled(d, features, values)).withColumn("__y", F.col(target).cast("double")) for d in (train, test)]
    common = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p"}
    if kind == "gbt":
        model = GBTRegressor(**common, seed=seed, **({"maxIter": 20, "maxDepth": 5, "stepSize": 0.1} | settings))
    elif kind == "forest":
        model = RandomForestRegressor(**common, seed=seed, **({"numTrees": 50, "maxDepth": 8} | settings))
    elif kind == "linear":
        model = LinearRegression(**common, **settings)
    else:
        raise ValueError(f"unknown kind {kind}")
    fitted = model.fit(ready[0])
    row = regression_scores(fitted.transform(ready[1]), "__y", "__p").first()
    return fitted, Metrics(row.r2, row.mae, row.rmse, train.count(), row.n, columns)


def ablation(df: DataFrame, tiers: dict[str, list[str]], target: str, baseline: str, kind: str = "gbt", always: list[str] = (), **settings) -> list[dict]:
    """Scores of feature tiers on one split (column is_test) and each one's gain in R2 over the baseline tier."""
    train, test = df.where(~F.col("is_test")).cache(), df.where("is_test").cache()
    rows = []
    for tier, features in tiers.items():
        kept = covered_columns(train, features, always=list(always))
        _, m = fit_and_score(train, test, kept, target, kind, **settings)
        rows.append({"tier": tier, **m.rounded()})
    base = next(r["r2"] for r in rows if r["tier"] == baseline)
    train.unpersist()
    test.unpersist()
    return [r | {"delta_r2": None if r["r2"] is None or base is None else round(r["r2"] - base, 4)} for r in rows]


def leave_one_device_out(df: DataFrame, device: str, features: list[str], target: str, kind: str = "gbt", **settings) -> list[dict]:
    """Train on all devices but one and score on that one; straight lines are fitted all at once."""
    names = device_names(df, device)
    if kind == "linear" and not settings:
        cases = [linear.Case(F.col(device) != d, F.col(device) == d, features) for d in names]
        return [{"test_device": d, **as_metrics(s).rounded()} for d, s in zip(names, linear.scores(df, target, cases), strict=True)]
    out = []
    for d in names:
        _, m = fit_and_score(df.where(F.col(device) != d), df.where(F.col(device) == d), features, target, kind, **settings)
        out.append({"test_device": d, **m.rounded()})
    return out


def device_transfer(df: DataFrame, device: str, features: list[str], target: str) -> list[dict]:
    """Straight lines of all other devices on each device, and of the training rows of all on their test rows (is_test)."""
    names = device_names(df, device)
    cases = [linear.Case(F.col(device) != d, F.col(device) == d, features) for d in names] + [linear.Case(~F.col("is_test"), F.col("is_test"), features)]
    return [{"test_device": d, **as_metrics(s).rounded()} for d, s in zip([*names, "pooled"], linear.scores(df, target, cases), strict=True)]


#: Share of training rows in which a feature must have a value.
COVERAGE = 0.10
#: Devices that a series of models may leave out one by one.
MOST_DEVICES = 1000


def device_names(df: DataFrame, device: str) -> list:
    names = [r[0] for r in df.select(device).where(F.col(device).isNotNull()).distinct().limit(MOST_DEVICES + 1).collect()]
    if len(names) > MOST_DEVICES:
        raise ValueError(f"{device} has more than {MOST_DEVICES} values")
    return sorted(names)


def as_metrics(s: linear.Score) -> Metrics:
    return Metrics(s.r2, s.mae, s.rmse, s.fit.n_train, s.n_test, s.fit.columns)


def repeated_linear(df: DataFrame, seeds, tiers: dict[str, list[str]], target: str, baseline: str, pool: Column | None = None, pools: list = (None,), always: list[str] = ()) -> list[dict]:
    """``ablation`` of straight lines for each pool and seed, in the same few passes however many there are.

    ``df`` has a column ``is_test_<seed>`` for each seed (see ``splits.group_holdouts``).
    """
    names = [(p, s, t) for p in pools for s in seeds for t in tiers]
    inside = lambda p: F.lit(True) if pool is None else pool == p
    train = {(p, s): inside(p) & ~F.col(f"is_test_{s}") for p in pools for s in seeds}
    cases = [linear.Case(train[p, s], inside(p) & F.col(f"is_test_{s}"), tiers[t], COVERAGE, list(always)) for p, s, t in names]
    found = {n: as_metrics(s).rounded() for n, s in zip(names, linear.scores(df, target, cases), strict=True)}
    out = []
    for p, s, t in names:
        m, base = found[p, s, t], found[p, s, baseline]["r2"]
        out.append({"pool": p, "split_seed": s, "tier": t, **m, "delta_r2": None if m["r2"] is None or base is None else round(m["r2"] - base, 4)})
    return out


def repeated(df: DataFrame, split, seeds, tiers: dict[str, list[str]], target: str, baseline: str, **settings) -> list[dict]:
    """``ablation`` under each seed's split: a fit for each seed and tier, for kinds that can't be fitted together."""
    return [r | {"split_seed": s} for s in seeds for r in ablation(split(df, s), tiers, target, baseline, **settings)]


def cross_validated(df: DataFrame, fold: str, folds: int, features: list[str], target: str, kind: str = "gbt", **settings) -> list[dict]:
    """Scores on each fold (0 to folds - 1) of models of the other ones; give it training rows only.

    Straight lines are fitted all at once.
    """
    if kind == "linear" and not settings:
        cases = [linear.Case(F.col(fold) != k, F.col(fold) == k, features) for k in range(folds)]
        return [{"fold": k, **as_metrics(s).rounded()} for k, s in enumerate(linear.scores(df, target, cases))]
    out = []
    for k in range(folds):
        _, m = fit_and_score(df.where(F.col(fold) != k), df.where(F.col(fold) == k), features, target, kind, **settings)
        out.append({"fold": k, **m.rounded()})
    return out


def window_ablation(windows: dict[int, DataFrame], base: list[str], target: str, kind: str = "gbt", **settings) -> list[dict]:
    """Scores of the features that all window lengths have, for each length, and their gain over the base tier.

    The base tier doesn't depend on the windows, so it is fitted once, on the first length's split (column is_test).
    """
    common = [c for c in common_columns([d.columns for d in windows.values()]) if c not in (*base, target, "is_test")]
    numbers = [c for c in common if dict(next(iter(windows.values())).dtypes)[c] in ("double", "float")]
    if kind == "linear" and not settings:
        every = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("__length"), "is_test", target, *base, *numbers) for k, d in windows.items()])
        at = lambda k, test: (F.col("__length") == k) & (F.col("is_test") if test else ~F.col("is_test"))
        lengths = list(windows)
        cases = [linear.Case(at(k, False), at(k, True), f) for k, f in [(lengths[0], base), *[(k, [*base, *numbers]) for k in lengths]]]
        first, *rest = [as_metrics(s).rounded() for s in linear.scores(every, target, cases)]
        return [{"window": k, **m, "delta_r2": None if m["r2"] is None or first["r2"] is None else round(m["r2"] - first["r2"], 4)} for k, m in zip(lengths, rest, strict=True)]
    out, floor = [], None
    for length, df in windows.items():
        train, test = df.where(~F.col("is_test")), df.where("is_test")
        if floor is None:
            floor = fit_and_score(train, test, base, target, kind, **settings)[1].rounded()["r2"]
        m = fit_and_score(train, test, [*base, *numbers], target, kind, **settings)[1].rounded()
        out.append({"window": length, **m, "delta_r2": None if m["r2"] is None or floor is None else round(m["r2"] - floor, 4)})
    return out


def robust_in_largest(df: DataFrame, bucket: str, features: list[str], target: str, kind: str = "gbt", least: float = 0.85, **settings) -> dict:
    """Scores within the rows of the most frequent bucket (the smallest of equals), and whether R2 holds there."""
    (row,) = modal_value(df, bucket).collect()
    rows = df.where(F.col(bucket) == row[0])
    _, m = fit_and_score(rows.where(~F.col("is_test")), rows.where("is_test"), features, target, kind, **settings)
    return {"bucket": row[0], "rows": row["n"], **m.rounded(), "robust": m.r2 is not None and m.r2 >= least}


def class_shift(df: DataFrame, lower: list[str], higher: list[str], target: str, kind: str = "gbt", **settings) -> DataFrame:
    """Test rows with the distance classes (target_class, lower_class, higher_class) that two tiers predict."""
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    out = test
    for name, features in (("lower", lower), ("higher", higher)):
        model, m = fit_and_score(train, test, features, target, kind, **settings)
        out = predicted(model, train, out, features, f"{name}_class")
        out = out.withColumn(f"{name}_class", distance_class(F.col(f"{name}_class")))
    return out.withColumn("target_class", distance_class(F.col(target)))


def predicted(model, train: DataFrame, df: DataFrame, features: list[str], name: str) -> DataFrame:
    """``df`` with a model's prediction; missing features are filled as in training."""
    from pyspark.ml.feature import VectorAssembler

    ready = filled(df.withColumns({f"__was_{c}": F.col(c) for c in features}), features, medians(train, features))
    assembled = VectorAssembler(inputCols=[*features, *[f"{c}__missing" for c in features]], outputCol="__x").transform(ready)
    scored = model.transform(assembled).withColumn(name, F.col("__p"))
    return scored.select(*[F.col(f"__was_{c}").alias(c) if c in features else F.col(c) for c in df.columns], name)


#: Buckets by hash over which a shuffle is dealt, at least and at most, and rows of each about.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET = 256, 1 << 16, 1 << 18


def shuffled(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """Adds <column>__shuffled: values of another row, one to one, in one ring over all rows.

    Rows stand in the order of a hash of their key, and each takes the next one's values, the last the first one's.
    Each bucket of equal beginnings of the hash is sorted alone, there are as many as the rows ask for, and the last row
    of each takes the values of the first row of the next bucket that has rows.
    """
    buckets = 1 << (max(LEAST_BUCKETS, min(MOST_BUCKETS, df.count() // BUCKET)) - 1).bit_length()
    h = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)
    number = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    rows = df.withColumn("__h", h).withColumn("__b", F.floor(number * buckets / F.lit(1 << 32)).cast("int"))
    order = F.struct(F.col("__h"), F.col(key))
    firsts = rows.groupBy("__b").agg(F.min_by(F.struct(*columns), order).alias("__first"))
    ring = Window.orderBy("__b")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(F.col("__b").alias("__n"), F.coalesce(F.lead("__first").over(ring), F.first("__first").over(whole)).alias("__after"))
    w = Window.partitionBy("__b").orderBy("__h", key)
    # The values inside a struct, so that a missing one is handed on as missing.
    led = rows.withColumn("__next", F.lead(F.struct(*columns)).over(w)).join(after, F.col("__b") == F.col("__n"))
    taken = F.coalesce("__next", "__after")
    return led.withColumns({f"{c}__shuffled": taken[c] for c in columns}).drop("__h", "__b", "__n", "__next", "__after")


def permutation_importance(model, train: DataFrame, test: DataFrame, key: str, features: list[str], target: str, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """(by, feature, category, importance, rank): how much the mean absolute error grows with a feature's values shuffled."""
    mixed = shuffled(test.where(F.col(target).isNotNull()), key, features, seed)
    scored = predicted(model, train, mixed, features, "__base")
    error = lambda c: F.abs(F.col(target) - F.col(c))
    for f in features:
        turned = scored.withColumns({f"__keep_{f}": F.col(f), f: F.col(f"{f}__shuffled")})
        scored = predicted(model, train, turned, features, f"__with_{f}").withColumn(f, F.col(f"__keep_{f}")).drop(f"__keep_{f}")
    wide = scored.groupBy(*by).agg(*[(F.avg(error(f"__with_{f}")) - F.avg(error("__base"))).alias(f"i{k}") for k, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"i{k}").alias("importance")) for k, f in enumerate(features)])
    long = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.feature", sensor_category(F.col("r.feature")).alias("category"), "r.importance")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")))


def with_device_columns(df: DataFrame, device: str, names: list[str]) -> DataFrame:
    """A column of 0 and 1 for each device, by which a linear model tells devices apart."""
    return df.withColumns({f"is_{k}": F.coalesce((F.col(device) == n).cast("double"), F.lit(0.0)) for k, n in enumerate(names)})


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, share of the gain) of tree models, largest first."""
    weights = model.featureImportances.toArray()
    return sorted(zip(features, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))


def ordinary_least_squares(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rows with ``prediction`` of a straight line for each group: one aggregation, joined back."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
    return df.join(fit, by).withColumn("prediction", F.col("__a") * F.col(x) + F.col("__b")).drop("__a", "__b")


def gain(higher: Column, lower: Column) -> Column:
    return higher - lower
