"""Statistics behind tables and figures, as aggregations that combine before they shuffle where that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, group_quantiles, ranked, with_medians


def half_open_bin(x: Column, edges: list[float]) -> Column:
    """Index of the bin [edge i, edge i+1) over inner edges: 0 below the first, len(edges) from the last on."""
    return sum(((x >= e).cast("int") for e in edges[1:]), (x >= edges[0]).cast("int"))


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str] = ()) -> DataFrame:
    """(by, bin, low, high, n): values are clipped to the edges' range; the last bin has its upper edge."""
    x = F.greatest(F.least(F.col(value), F.lit(edges[-1])), F.lit(edges[0]))
    k = F.least(half_open_bin(x, edges) - 1, F.lit(len(edges) - 2))
    lows, highs = (F.array(*[F.lit(float(e)) for e in part]) for part in (edges[:-1], edges[1:]))
    n = df.where(F.col(value).isNotNull()).withColumn("bin", k).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*by, "bin", F.get(lows, F.col("bin")).alias("low"), F.get(highs, F.col("bin")).alias("high"), "n")


def binned_means(df: DataFrame, x: str, y: str, value: str, x_edges: list[float], y_edges: list[float], least: int = 20) -> DataFrame:
    """(x_bin, y_bin, n, mean): bins between inner edges; means of fewer than ``least`` rows are blank."""
    rows = df.where(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    g = rows.select(half_open_bin(F.col(x), x_edges).alias("x_bin"), half_open_bin(F.col(y), y_edges).alias("y_bin"), value)
    return g.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")).select("x_bin", "y_bin", "n", F.when(F.col("n") >= least, F.col("m")).alias("mean"))


def _literals(values: list[float | None]) -> Column:
    """Distinct values as an array; none of them if there were no rows."""
    return F.array(*[F.lit(v) for v in dict.fromkeys(values) if v is not None]).cast("array<double>")


def median_trend(df: DataFrame, x: str, y: str, groups: int = 40, least: int = 20) -> DataFrame:
    """(bin, n, x_median, y_median) over bins of nearly equal counts (edge i-1 < x <= edge i), x clipped at 0."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.greatest(F.col(x), F.lit(0.0)).alias("x"), F.col(y).alias("y"))
    points = [k / (groups - 1) for k in range(groups)]
    edges = _literals(exact_quantiles(rows, "x", points))
    binned = rows.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("x"))))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return with_medians(counts, binned, ["bin"], {"x": "x_median", "y": "y_median"})


def elbow(trend: DataFrame) -> DataFrame:
    """Where the trend rises most between neighbours: (elbow, step); ``trend`` has at most a few dozen rows."""
    w = Window.orderBy("bin")
    d = trend.select((F.col("y_median") - F.lag("y_median").over(w)).alias("step"), ((F.col("x_median") + F.lag("x_median").over(w)) / 2).alias("at"), "bin").where("step > 0")
    return d.agg(F.max_by("at", F.struct(F.col("step"), -F.col("bin"))).alias("elbow"), F.max("step").alias("step"))


def quantile_bins(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(bin, n, x_median, y_median) over quantile bins; the first has its lower edge, equal edges are one."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = _literals(exact_quantiles(rows, x, [k / bins for k in range(bins + 1)]))
    k = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(x))), F.lit(1))
    binned = rows.withColumn("bin", k)
    return with_medians(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), binned, ["bin"], {x: "x_median", y: "y_median"})


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of rows with both; null where one of them is constant."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def average_ranks(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """(by, column, name): for each distinct value its rank from 1 within its group, which equal values share as their mean."""
    return ranked(df, column, by).select(*by, F.col("x").alias(column), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): rank correlation of rows with both; equal values share their mean rank."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    pairs = rows.groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).alias("__w"))
    ranks = pairs
    for c in ("__x", "__y"):
        r = average_ranks(rows, c, by, f"{c}r")
        right = r.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(by)], F.col(c).alias("__v"), f"{c}r")
        ranks = ranks.join(right, [*[F.col(k).eqNullSafe(F.col(f"__b{i}")) for i, k in enumerate(by)], F.col(c) == F.col("__v")]).drop("__v", *[f"__b{i}" for i in range(len(by))])
    a, b, w = F.col("__xr"), F.col("__yr"), F.col("__w").cast("double")
    sums = ranks.groupBy(*by).agg(F.sum("__w").alias("n"), *[F.sum(w * v).alias(k) for k, v in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))])
    n = F.col("n").cast("double")
    cov, va, vb = F.col("ab") - F.col("a") * F.col("b") / n, F.col("aa") - F.col("a") * F.col("a") / n, F.col("bb") - F.col("b") * F.col("b") / n
    return sums.select(*by, "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, slope, intercept, r, share_above, median_x, median_y) of rows with both."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fitted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), correlation(F.col(x), F.col(y)).alias("r"),
        F.avg((F.col(y) > F.col(x)).cast("double")).alias("share_above"),
    )
    return with_medians(fitted, rows, by, {x: "median_x", y: "median_y"})


def category_correlation(df: DataFrame, features: dict[str, str], targets: list[str], by: list[str]) -> DataFrame:
    """(by, target, category, median_r): median over a category's features of the absolute correlation with a target."""
    pairs = [(f, c, t) for f, c in features.items() for t in targets]
    wide = df.groupBy(*by).agg(*[F.abs(correlation(F.col(f), F.col(t))).alias(f"r{k}") for k, (f, _, t) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("category"), F.col(f"r{k}").alias("r")) for k, (_, c, t) in enumerate(pairs)])
    return wide.select(*by, F.explode(rows).alias("x")).groupBy(*by, "x.target", "x.category").agg(F.median("x.r").alias("median_r"))


def top_by_size(df: DataFrame, value: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest absolute value."""
    return df.orderBy(F.abs(value).desc(), *ties).limit(k)


def value_shares(df: DataFrame, scope: str, value: str, top: int) -> DataFrame:
    """(scope, value, n, share, rank) of the most frequent values in each scope and over all (scope ALL).

    Counts by scope are combined once; grouping sets add the overall ones.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(scope, value).agg(F.count(F.lit(1)).alias("n"))
    both = n.groupingSets([[scope, value], [value]], scope, value).agg(F.sum("n").alias("n"), F.grouping(scope).alias("g"))
    named = both.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(scope).cast("string")).alias("scope"), F.col(value).alias("value"), "n")
    totals = named.groupBy("scope").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "value"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "scope").select("scope", "value", "n", (100.0 * F.col("n").cast("double") / F.col("total")).alias("share"), "rank")


def modal_value(df: DataFrame, value: str) -> DataFrame:
    """(value, n) of the most frequent value; the smallest of equals."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), value).limit(1)


def rows_with_mode(df: DataFrame, value: str) -> DataFrame:
    return df.join(F.broadcast(modal_value(df, value).select(value)), value, "left_semi")


def cap_at_quantile(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """``value`` no larger than its quantile."""
    (cap,) = exact_quantiles(df, value, [q])
    return df if cap is None else df.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.col(value), F.lit(cap))))


def daily(df: DataFrame, ts: str, value: str, least: int = 20, others: dict[str, str] | None = None) -> DataFrame:
    """(day, n, mean, p25, p75, means of others) of days with ``least`` rows or more."""
    extra = [F.avg(c).alias(a) for a, c in (others or {}).items()]
    rows = df.where(F.col(value).isNotNull()).withColumn("day", F.to_date(ts))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *extra).where(F.col("n") >= least)
    q = group_quantiles(rows, value, [0.25, 0.75], ["day"], "__q").withColumnRenamed("day", "__day")
    both = days.join(q, F.col("day").eqNullSafe(F.col("__day"))).withColumns({"p25": F.get("__q", F.lit(0)), "p75": F.get("__q", F.lit(1))})
    return both.select("day", "n", "mean", "p25", "p75", *(others or {}))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"))
    return with_medians(out, df, by, {value: "median"})


def class_shares(df: DataFrame, cls: str, value: str, by: list[str]) -> DataFrame:
    """(by, n, median, share0, share1, share2) in percent."""
    rows = df.where(F.col(cls).isNotNull())
    shares = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[(100.0 * F.avg((F.col(cls) == k).cast("double"))).alias(f"share{k}") for k in range(3)])
    return with_medians(shares, rows, by, {value: "median"})


def transitions(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(by, from, to0, to1, to2): counts of class changes as percent of each row; a row without counts is absent."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("from")).pivot(b, [0, 1, 2]).agg(F.count(F.lit(1))).na.fill(0, ["0", "1", "2"])
    total = (F.col("0") + F.col("1") + F.col("2")).cast("double")
    return n.select(*by, "from", *[(100.0 * F.col(str(k)) / total).alias(f"to{k}") for k in range(3)])


def transition_summary(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(by, n, changed, improved, worsened) in percent; class 0 is the best."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pct = lambda c: (100.0 * F.avg(c.cast("double")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pct(F.col(a) != F.col(b)).alias("changed"), pct(F.col(b) < F.col(a)).alias("improved"), pct(F.col(b) > F.col(a)).alias("worsened"))


def regression_scores(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """(by, n, r2, mae, rmse); r2 is null where y is constant.  Two combinable sums, no second pass over the rows."""
    e = F.col(y) - F.col(prediction)
    g = df.where(F.col(y).isNotNull() & F.col(prediction).isNotNull()).groupBy(*by)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return out.select(*by, "n", (1 - F.try_divide(F.col("sse"), F.nullif(F.col("sst"), F.lit(0.0)))).alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, truth, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_scores(df: DataFrame, truth: str, prediction: str, classes: list[int]) -> DataFrame:
    """One row: n, accuracy, macro_f1, weighted_f1 and f1 of each class (0 where it is 0/0)."""
    c = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    t, p = F.col(truth), F.col(prediction)
    wide = c.agg(F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), *[x for k in classes for x in (F.count_if((t == k) & (p == k)).alias(f"tp{k}"), F.count_if(t == k).alias(f"t{k}"), F.count_if(p == k).alias(f"p{k}"))])
    f1 = {k: F.coalesce(F.try_divide(2.0 * F.col(f"tp{k}"), (F.col(f"t{k}") + F.col(f"p{k}")).cast("double")), F.lit(0.0)) for k in classes}
    macro = sum((f1[k] for k in classes[1:]), f1[classes[0]]) / len(classes)
    weighted = sum((f1[k] * F.col(f"t{k}") for k in classes[1:]), f1[classes[0]] * F.col(f"t{classes[0]}")) / F.col("n")
    return wide.select("n", "accuracy", macro.alias("macro_f1"), weighted.alias("weighted_f1"), *[f1[k].alias(f"f1_{k}") for k in classes])


def split_summary(df: DataFrame, keys: list[str], value: str, baseline: Column | None = None) -> DataFrame:
    """(keys, n, median, mean, sd, least, largest, resolved): whether mean +- sd leaves out 0 (blank for the baseline)."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("largest"))
    out = with_medians(out, df, keys, {value: "median"})
    yes = (F.col("mean") - F.col("sd") > 0) | (F.col("mean") + F.col("sd") < 0)
    resolved = F.when(F.coalesce(yes, F.lit(False)), "yes").otherwise("no")
    return out.withColumn("resolved", F.when(baseline, "").otherwise(resolved) if baseline is not None else resolved)


def against_baseline(df: DataFrame, keys: list[str], is_baseline: Column, value: str) -> DataFrame:
    """``delta``: value less the baseline row's of the same keys (null where there is none)."""
    base = F.max(F.when(is_baseline, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("delta", F.col(value) - base)


def in_given_order(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), *then)


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for a seed however rows are dealt."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
