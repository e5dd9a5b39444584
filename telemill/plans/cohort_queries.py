"""Pools of rows, coverage by month, onsets and splits, on orders and their items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.functions import times
from telemill.operators import cohorts, splits, stats
from telemill.operators.quantiles import exact_quantiles, with_medians

from .catalog import query, table


@query(
    "F10 A12 E12",
    "SELECT 'A' AS pool, count_if(strftime(o_orderdate, '%Y-%m') >= '1996-01') AS rows, count_if(strftime(o_orderdate, '%Y-%m') >= '1996-01' AND o_orderstatus <> 'P') AS with_target FROM orders UNION ALL SELECT 'B', count_if(strftime(o_orderdate, '%Y-%m') <> '1995-03'), count_if(strftime(o_orderdate, '%Y-%m') <> '1995-03' AND o_orderstatus <> 'P') FROM orders",
)
def month_pool_counts(spark, sf_dir):
    m = times.month(F.col("o_orderdate"))
    target = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return cohorts.memberships(table(spark, sf_dir, "orders"), {"A": m >= "1996-01", "B": m != "1995-03"}, target)


_FUNNEL = """
f AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, CASE WHEN NOT coalesce(o_totalprice > 50000, false) THEN 0 WHEN NOT coalesce(o_orderstatus <> 'F', false) THEN 1 WHEN NOT coalesce(o_orderpriority < '4', false) THEN 2 ELSE 3 END AS p FROM orders),
s AS (SELECT * FROM (VALUES (0, 'all'), (1, 'price'), (2, 'open'), (3, 'priority')) AS v(step, name)),
x AS (SELECT step, name, m, count_if(p >= step) AS n, count_if(p = step - 1) AS lost FROM f, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY lost DESC, m) AS k FROM x)
"""


@query(
    "A13 V16",
    f"WITH {_FUNNEL} SELECT step::BIGINT AS step, name, sum(n)::BIGINT AS rows, sum(lost)::BIGINT AS removed, round(100 * sum(n) / (SELECT count(*) FROM orders)::DOUBLE, 1) AS share, coalesce(string_agg(m || ': ' || lost, ', ' ORDER BY k) FILTER (lost > 0 AND k <= 3), '') || CASE WHEN count_if(lost > 0) > 3 THEN ' +' || (count_if(lost > 0) - 3) || ' more months' ELSE '' END AS why FROM r GROUP BY step, name",
)
def selection_funnel(spark, sf_dir):
    steps = [("price", F.col("o_totalprice") > 50000), ("open", F.col("o_orderstatus") != "F"), ("priority", F.col("o_orderpriority") < "4")]
    out = cohorts.funnel(table(spark, sf_dir, "orders"), steps, "o_orderdate")
    return out.withColumn("step", F.col("step").cast("long"))


@query(
    "A7 A8 A29 A36 U1",
    "WITH r AS (SELECT l_linestatus AS device, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT l_orderkey) AS jobs, round(100 * avg((l_returnflag <> 'N')::INT), 1) AS sensor_share, median(l_quantity) AS median_age FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, strftime(l_shipdate, '%Y-%m')), (l_linestatus))) SELECT device, coalesce(month, 'all') AS month, rows, jobs, sensor_share, median_age FROM r",
)
def coverage_by_group_month_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("device"), times.month(F.col("l_shipdate")).alias("month"), "l_orderkey", "l_returnflag", "l_quantity")
    # Jobs by month first: what is left for the totals is a few numbers a job or a month.
    jobs = li.groupBy("device", "month", "l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_returnflag") != "N").alias("flagged"))
    months = jobs.groupBy("device", "month").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("jobs"), F.sum("flagged").alias("flagged"))
    totals = months.groupBy("device").agg(F.sum("rows").alias("rows"), F.sum("flagged").alias("flagged"))
    distinct = jobs.groupBy("device", "l_orderkey").agg(F.lit(1).alias("one")).groupBy("device").agg(F.count(F.lit(1)).alias("jobs"))
    months = with_medians(months, li, ["device", "month"], {"l_quantity": "median_age"})
    totals = with_medians(totals.join(distinct, "device"), li, ["device"], {"l_quantity": "median_age"})
    share = F.round(100.0 * F.col("flagged") / F.col("rows"), 1).alias("sensor_share")
    columns = ["device", "month", "rows", "jobs", share, "median_age"]
    return months.select(*columns).unionByName(totals.withColumn("month", F.lit("all")).select(*columns))


@query(
    "A9 A10 A11 U5",
    "WITH w AS (SELECT strftime(ts, '%Y-%m') AS month, avg((event_type = 'click')::INT) AS a, avg((value IS NOT NULL)::INT) AS b, avg((value > 50)::INT) AS c FROM events GROUP BY 1) SELECT month, 'click' AS channel, round(a, 6) AS share FROM w UNION ALL SELECT month, 'value', round(b, 6) FROM w UNION ALL SELECT month, 'high', round(c, 6) FROM w",
)
def channel_month_presence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    share = lambda c: F.avg(c.cast("double"))
    wide = e.groupBy(times.month(F.col("ts")).alias("month")).agg(share(F.col("event_type") == "click").alias("click"), share(F.col("value").isNotNull()).alias("value"), share(F.col("value") > 50).alias("high"))
    return wide.unpivot("month", ["click", "value", "high"], "channel", "share").withColumn("share", F.round("share", 6))


@query(
    "W3 W4 U4 U6 T9",
    "WITH f AS (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS m FROM orders GROUP BY 1), n AS (SELECT m, count(*) AS c FROM f GROUP BY 1), cal AS (SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS d FROM orders)) SELECT month, coalesce(c, 0)::BIGINT AS onsets, (sum(coalesce(c, 0)) OVER (ORDER BY month))::BIGINT AS cumulative FROM cal LEFT JOIN n ON n.m = cal.month",
)
def onset_cumulative(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(times.month(F.min("o_orderdate")).alias("month"))
    n = first.groupBy("month").agg(F.count(F.lit(1)).alias("onsets"))
    # One row a month from here on.
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    filled = times.calendar(o, "o_orderdate").join(n, "month", "left").na.fill(0, ["onsets"])
    return filled.withColumn("cumulative", F.sum("onsets").over(w))


@query(
    "A21 W6 D16 A22 W9",
    "WITH c AS (SELECT l_returnflag AS scope, l_quantity::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT * FROM c UNION ALL SELECT 'ALL', value, sum(n)::BIGINT FROM c GROUP BY value), t AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY scope) AS total FROM b) SELECT scope, value, n, round(100 * n / total::DOUBLE, 6) AS share, rank::BIGINT AS rank, round(CASE WHEN value > 0 THEN 1 / sqrt(value) END, 6) AS floor FROM t WHERE rank <= 5",
)
def topn_share_floor(spark, sf_dir):
    from telemill.functions.distributions import noise_floor

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("v"))
    out = stats.value_shares(rows, "l_returnflag", "v", 5)
    return out.select("scope", "value", "n", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"), F.round(noise_floor(F.col("value")), 6).alias("floor"))


_FORWARD = "j AS (SELECT o_orderkey, o_custkey, epoch(min(o_orderdate) OVER (PARTITION BY o_custkey)) AS t FROM orders), c AS (SELECT quantile_cont(t, 0.8) AS cut FROM j)"


@query("W1 W2 E17", f"WITH {_FORWARD} SELECT o_orderkey, t AS job_time, coalesce(t > cut, false) AS is_test FROM j, c")
def forward_split_cut(spark, sf_dir):
    return splits.forward_split(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_orderkey", "job_time", "is_test")


_GROUPS = "g AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256(o_custkey::VARCHAR || ':42')) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT o_custkey FROM orders))"


@query("M3 M4 T6", f"WITH {_GROUPS} SELECT o_orderkey, r <= ceil(0.2 * k) AS is_test FROM orders JOIN g USING (o_custkey)")
def group_split_hash(spark, sf_dir):
    return splits.group_holdout(table(spark, sf_dir, "orders"), "o_custkey", 42).select("o_orderkey", "is_test")


@query(
    "U3 M15",
    f"WITH {_FORWARD}, {_GROUPS}, f AS (SELECT o_orderstatus AS s, 'forward' AS kind, o_totalprice AS p FROM j JOIN orders USING (o_orderkey), c WHERE t > cut UNION ALL SELECT o_orderstatus, 'random', o_totalprice FROM orders JOIN g USING (o_custkey) WHERE r <= ceil(0.2 * k)) SELECT s AS status, round(avg(p) FILTER (kind = 'forward'), 4) AS forward, round(avg(p) FILTER (kind = 'random'), 4) AS random, round(avg(p) FILTER (kind = 'forward') - avg(p) FILTER (kind = 'random'), 4) AS change FROM f GROUP BY 1",
)
def pivot_random_forward(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pick = lambda df, kind: df.where("is_test").select(F.col("o_orderstatus").alias("status"), F.lit(kind).alias("kind"), "o_totalprice")
    both = pick(splits.forward_split(o, "o_custkey", "o_orderdate"), "forward").unionByName(pick(splits.group_holdout(o, "o_custkey", 42), "random"))
    p = both.groupBy("status").pivot("kind", ["forward", "random"]).agg(F.avg("o_totalprice"))
    return p.select("status", F.round("forward", 4).alias("forward"), F.round("random", 4).alias("random"), F.round(F.col("forward") - F.col("random"), 4).alias("change"))


@query("F11 F12 J10 A9", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') AND o_totalprice IS NOT NULL AND (SELECT epoch_us(max(l_shipdate)) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) - epoch_us(o_orderdate) <= 48 * 86400000000")
def avail_pool(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1.0)).alias("sc_x"), F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(flags, "o_orderkey", "left").withColumn("age", times.age_hours(F.col("last"), F.col("o_orderdate")) / 24)
    return rows.where(cohorts.available(["sc_x"], ["o_totalprice"], F.col("age"))).select("o_orderkey")


@query("T8 J16", "SELECT d AS device, (row_number() OVER (ORDER BY d) - 1)::INT AS device_encoded FROM (SELECT DISTINCT lang AS d FROM documents)")
def device_encoding(spark, sf_dir):
    return cohorts.device_codes(table(spark, sf_dir, "documents").withColumnRenamed("lang", "device"), "device")


@query("A23", "WITH j AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT median(n)::DOUBLE AS median_size, max(n) AS largest, count(*) AS jobs FROM j")
def job_sizes(spark, sf_dir):
    j = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    (median,) = exact_quantiles(j, "n", [0.5])
    return j.agg(F.lit(median).cast("double").alias("median_size"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("jobs"))
