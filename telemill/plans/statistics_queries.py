"""Statistics behind figures, on line items, parts and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions.distributions import distance_class
from telemill.operators import models, stats

from .catalog import query, table

_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 45.0]
_X = [10.0, 20.0, 30.0, 40.0]
_Y = [0.02, 0.05, 0.08]


@query("A16 E12", "SELECT o_orderdate::DATE AS day, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1 HAVING count(*) >= 5")
def daily_quantiles(spark, sf_dir):
    out = stats.daily(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 5)
    return out.select("day", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p25", "p75")])


@query("A17 E16 F13", "WITH b AS (SELECT (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT AS x, (l_discount >= 0.02)::INT + (l_discount >= 0.05)::INT + (l_discount >= 0.08)::INT AS y, l_extendedprice AS v FROM lineitem) SELECT x AS x_bin, y AS y_bin, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(v), 4) END AS mean FROM b GROUP BY ALL")
def binned_2d_mean(spark, sf_dir):
    return stats.binned_means(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", _X, _Y).withColumn("mean", F.round("mean", 4))


@query("A18", "SELECT l_linestatus, b::INT AS bin, count(*) AS n FROM (SELECT l_linestatus, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS b FROM lineitem) GROUP BY ALL")
def histogram_edges(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", _EDGES, ["l_linestatus"]).select("l_linestatus", "bin", "n")


_TREND = "e AS (SELECT list_distinct(quantile_cont(greatest(l_extendedprice, 0), [k / 39.0 for k in range(40)])) AS edges FROM lineitem), b AS (SELECT len(list_filter(edges, lambda z: z < greatest(l_extendedprice, 0))) AS bin, l_extendedprice AS x, l_quantity AS y FROM lineitem, e), m AS (SELECT bin, count(*) AS n, median(x) AS mx, median(y) AS my FROM b GROUP BY 1 HAVING count(*) >= 20)"


@query("A27 W7 E17", f"WITH {_TREND}, d AS (SELECT bin, my - lag(my) OVER (ORDER BY bin) AS s, (mx + lag(mx) OVER (ORDER BY bin)) / 2 AS pos FROM m) SELECT round(arg_max(pos, (s, -bin)), 4) AS elbow, round(max(s), 4) AS step FROM d WHERE s > 0")
def median_trend_elbow(spark, sf_dir):
    out = stats.elbow(stats.median_trend(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"))
    return out.select(F.round("elbow", 4).alias("elbow"), F.round("step", 4).alias("step"))


@query("A28", "WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice, [k / 30.0 for k in range(31)])) AS edges FROM part), b AS (SELECT greatest(len(list_filter(edges, lambda z: z < p_retailprice)), 1)::INT AS bin, p_retailprice AS x, p_size AS y FROM part, e) SELECT bin, count(*) AS n, round(median(x), 4) AS x_median, round(median(y), 4) AS y_median FROM b GROUP BY 1")
def quantile_bin_medians(spark, sf_dir):
    out = stats.quantile_bins(table(spark, sf_dir, "part"), "p_retailprice", "p_size")
    return out.select("bin", "n", F.round("x_median", 4).alias("x_median"), F.round("y_median", 4).alias("y_median"))


@query("A24 A35", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg((l_extendedprice > l_quantity)::INT), 6) AS share_above, median(l_quantity) AS median_x, round(median(l_extendedprice), 4) AS median_y FROM lineitem GROUP BY 1")
def linear_fit_by_group(spark, sf_dir):
    out = stats.linear_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"), F.round("share_above", 6).alias("share_above"), "median_x", F.round("median_y", 4).alias("median_y"))


@query("A26 W5", "WITH r AS (SELECT l_returnflag, l_linestatus, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL")
def spearman_by_group(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"]).withColumn("rho", F.round("rho", 6))


@query("A25 P19", "WITH c AS (SELECT l_linestatus AS device, abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(l_tax, l_extendedprice)) AS c FROM lineitem GROUP BY 1) SELECT device, 'l_extendedprice' AS target, 'size' AS category, round(a, 6) AS median_r FROM c UNION ALL SELECT device, 'l_extendedprice', 'rate', round((b + c) / 2, 6) FROM c")
def pearson_category_median(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "device")
    out = stats.category_correlation(li, {"l_quantity": "size", "l_discount": "rate", "l_tax": "rate"}, ["l_extendedprice"], ["device"])
    return out.withColumn("median_r", F.round("median_r", 6))


_CLASSES = "c AS (SELECT l_linestatus AS device, l_discount * 8 AS h, CASE WHEN l_discount * 8 < 0.3 THEN 0 WHEN l_discount * 8 < 0.6 THEN 1 ELSE 2 END AS a, CASE WHEN l_tax * 10 < 0.3 THEN 0 WHEN l_tax * 10 < 0.6 THEN 1 ELSE 2 END AS b FROM lineitem)"


def _classes(spark, sf_dir):
    h, g = F.col("l_discount") * 8, F.col("l_tax") * 10
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("device"), h.alias("h"), distance_class(h).alias("a"), distance_class(g).alias("b"))


@query("A19 D15", f"WITH {_CLASSES} SELECT device, count(*) AS n, round(median(h), 6) AS median, round(100 * avg((a = 0)::INT), 6) AS share0, round(100 * avg((a = 1)::INT), 6) AS share1, round(100 * avg((a = 2)::INT), 6) AS share2 FROM c GROUP BY 1")
def class_shares(spark, sf_dir):
    out = stats.class_shares(_classes(spark, sf_dir), "a", "h", ["device"])
    return out.select("device", "n", *[F.round(c, 6).alias(c) for c in ("median", "share0", "share1", "share2")])


@query("D18 W9 U3", f'WITH {_CLASSES} SELECT device, a AS "from", round(100 * avg((b = 0)::INT), 6) AS to0, round(100 * avg((b = 1)::INT), 6) AS to1, round(100 * avg((b = 2)::INT), 6) AS to2 FROM c GROUP BY ALL')
def class_transition(spark, sf_dir):
    out = stats.transitions(_classes(spark, sf_dir), "a", "b", ["device"])
    return out.select("device", "from", *[F.round(c, 6).alias(c) for c in ("to0", "to1", "to2")])


@query("D18", f"WITH {_CLASSES} SELECT device, count(*) AS n, round(100 * avg((a <> b)::INT), 6) AS changed, round(100 * avg((b < a)::INT), 6) AS improved, round(100 * avg((b > a)::INT), 6) AS worsened FROM c GROUP BY 1")
def class_change_summary(spark, sf_dir):
    out = stats.transition_summary(_classes(spark, sf_dir), "a", "b", ["device"])
    return out.select("device", "n", *[F.round(c, 6).alias(c) for c in ("changed", "improved", "worsened")])


@query("A30 M9 A24", "WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1), p AS (SELECT l_returnflag, l_extendedprice AS y, a * l_quantity + b AS q FROM lineitem JOIN f USING (l_returnflag)) SELECT l_returnflag, count(*) AS n, round(1 - sum((y - q) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - q)), 3) AS mae, round(sqrt(avg((y - q) ** 2)), 3) AS rmse FROM p GROUP BY 1")
def regression_metrics(spark, sf_dir):
    fitted = models.ordinary_least_squares(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    out = stats.regression_scores(fitted, "l_extendedprice", "prediction", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


@query("A31", "WITH c AS (SELECT quality AS t, (n_chars > 600)::INT AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), k AS (SELECT v AS k, coalesce(2.0 * count_if(t = v AND p = v) / nullif(count_if(t = v) + count_if(p = v), 0), 0)::DOUBLE AS f1, count_if(t = v) AS s FROM c, (VALUES (0), (1)) AS x(v) GROUP BY v) SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg((t = p)::INT), 6) FROM c) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s)::DOUBLE, 6) AS weighted_f1, round(max(f1) FILTER (k = 0), 6) AS f1_0, round(max(f1) FILTER (k = 1), 6) AS f1_1 FROM k")
def classification_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("p", (F.col("n_chars") > 600).cast("int"))
    out = stats.classification_scores(rows, "quality", "p", [0, 1])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "f1_0", "f1_1")])


_SPLITS = "s AS (SELECT l_linestatus AS device, l_returnflag AS tier, (l_orderkey % 5)::BIGINT AS seed, avg(l_discount) AS r2 FROM lineitem GROUP BY ALL), d AS (SELECT *, r2 - max(CASE WHEN tier = 'N' THEN r2 END) OVER (PARTITION BY device, seed) AS delta FROM s)"


def _split_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("device"), F.col("l_returnflag").alias("tier"), (F.col("l_orderkey") % 5).alias("seed")).agg(F.avg("l_discount").alias("r2"))
    return stats.against_baseline(rows, ["device", "seed"], F.col("tier") == "N", "r2")


@query("J13 M12 M18 M21", f"WITH {_SPLITS} SELECT device, tier, seed, round(r2, 6) AS r2, round(delta, 6) AS delta FROM d")
def delta_vs_baseline(spark, sf_dir):
    return _split_rows(spark, sf_dir).select("device", "tier", "seed", F.round("r2", 6).alias("r2"), F.round("delta", 6).alias("delta"))


@query("A14 A15 A32", f"WITH {_SPLITS} SELECT device, tier, count(delta) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, CASE WHEN tier = 'N' THEN '' WHEN avg(delta) - stddev_samp(delta) > 0 OR avg(delta) + stddev_samp(delta) < 0 THEN 'yes' ELSE 'no' END AS resolved FROM d GROUP BY device, tier")
def split_summary_resolved(spark, sf_dir):
    out = stats.split_summary(_split_rows(spark, sf_dir), ["device", "tier"], "delta", F.col("tier") == "N")
    return out.select("device", "tier", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "resolved")


@query("F15 A22", "WITH m AS (SELECT l_quantity AS q FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, q LIMIT 1) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity = (SELECT q FROM m)")
def modal_rows(spark, sf_dir):
    return stats.rows_with_mode(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("F14", "SELECT l_returnflag, round(avg(least(l_extendedprice, q)), 4) AS mean FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem) GROUP BY 1")
def capped_mean(spark, sf_dir):
    capped = stats.cap_at_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return capped.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("A20 A35", "SELECT l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop FROM lineitem GROUP BY 1")
def describe_by_device(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_linestatus"])
    return out.select("l_linestatus", "n", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), F.round("sd_pop", 6).alias("sd_pop"))


@query("T2 H17", "SELECT o_orderpriority AS pool, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END::BIGINT AS place FROM orders GROUP BY 1")
def custom_order(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT")), F.col("pool"))
    return stats.in_given_order(n, "pool", ["3-MEDIUM", "1-URGENT"], "pool").withColumn("place", F.when(place == 0, 3).otherwise(place).cast("long"))
