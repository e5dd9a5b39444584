"""Events as sensor series: windows, as-of values and the order of times."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import times
from telemill.operators import align, quality

from .catalog import query, table


@query(
    "J15 W8",
    "SELECT a.event_id, round(avg(b.value), 6) AS mean, min(b.value) AS least, max(b.value) AS largest, round(stddev_samp(b.value), 5) AS sd, count(b.value) AS n FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts BETWEEN a.ts - INTERVAL 5 HOUR AND a.ts GROUP BY 1",
)
def window_5h_sensor_agg(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = align.window_statistics(e, e, ["event_type"], "event_id", "ts", "ts", "value", 5 * 3600)
    return w.select("event_id", F.round("w__mean", 6).alias("mean"), F.col("w__min").alias("least"), F.col("w__max").alias("largest"), F.round("w__sd", 5).alias("sd"), F.col("w__count").alias("n"))


@query(
    "W8",
    "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)",
)
def trailing_window_2h(spark, sf_dir):
    w = align.trailing_window(table(spark, sf_dir, "events"), "event_type", "ts", "value", 2 * 3600)
    return w.select("event_id", F.round("w__mean", 6).alias("mean"), F.col("w__count").alias("n"))


@query(
    "J14 E11 J11",
    "WITH s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value IS NOT NULL GROUP BY ALL), j AS (SELECT a.event_id, a.ts, s.ts AS st, s.value FROM events a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.ts >= s.ts) SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(st) <= 48 * 3600000000 THEN value END AS calibration, round(CASE WHEN epoch_us(ts) - epoch_us(st) <= 48 * 3600000000 THEN (epoch_us(ts) - epoch_us(st)) / 3.6e9 END, 6) AS age_hours FROM j",
)
def asof_calibration_48h(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    samples = e.join(F.broadcast(kind), e.event_type == F.col("k"), "left_semi").select("user_id", "ts", "value")
    out = align.latest_before(e.select("user_id", "event_id", "ts"), samples, ["user_id"], "event_id", "ts", "ts", "value", 48)
    return out.select("event_id", F.col("value__asof").alias("calibration"), F.round("value__age_hours", 6).alias("age_hours"))


@query(
    "E8 E9 E10 E11 V6",
    "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN NOT (l_shipdate > o_orderdate + INTERVAL 30 DAY) THEN l_shipdate END AS scheduled, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9, 4) AS hours, strftime((o_orderdate AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def time_order_mask_utc(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    utc = F.to_utc_timestamp("o_orderdate", "Europe/Berlin")
    return both.select("o_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), times.not_after(F.col("l_shipdate"), F.col("o_orderdate"), 30 * 86400).alias("scheduled"), F.round(times.age_hours(F.col("l_shipdate"), F.col("o_orderdate")), 4).alias("hours"), F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


_CHANNELS = "w AS (SELECT event_type, event_id, min(value) OVER x AS a, max(value) OVER x AS b, count(value) OVER x AS n FROM events WINDOW x AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW))"


@query(
    "V12",
    f"WITH {_CHANNELS}, c AS (SELECT event_type, count_if(n > 0) >= 100 AS counted, count_if(n > 0 AND n <> 1) = 0 AS single, count_if(a IS NOT NULL AND NOT (a = 0 AND b = 0)) >= 100 AS judged, count_if(a IS NOT NULL AND NOT (a = 0 AND b = 0) AND a <> b) = 0 AS flat FROM w GROUP BY 1) SELECT round(count_if(counted AND single) / nullif(count_if(counted), 0)::DOUBLE, 6) AS share_single, round(count_if(judged AND flat) / nullif(count_if(judged), 0)::DOUBLE, 6) AS share_flat, coalesce((count_if(counted) >= 5 AND count_if(counted AND single) / nullif(count_if(counted), 0)::DOUBLE >= 0.9) OR (count_if(judged) >= 5 AND count_if(judged AND flat) / nullif(count_if(judged), 0)::DOUBLE >= 0.9), false) AS carried_forward FROM c",
)
def carried_forward_detector(spark, sf_dir):
    e = align.trailing_window(table(spark, sf_dir, "events"), "event_type", "ts", "value", 2 * 3600)
    out = quality.carried_forward(e, "event_type", "w")
    return out.select(F.round("share_single", 6).alias("share_single"), F.round("share_flat", 6).alias("share_flat"), "carried_forward")
