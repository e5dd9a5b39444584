"""Distances of outcome distributions: users' event types against all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import distributions as d

from .catalog import query, table

_SHARES = """
p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT user_id, sum(n)::BIGINT AS total FROM p GROUP BY 1),
g AS (SELECT event_type, count(*) / (SELECT count(*)::DOUBLE FROM events) AS q FROM events GROUP BY 1),
u AS (SELECT t.user_id, t.total, g.event_type, g.q, coalesce(p.n, 0) / t.total::DOUBLE AS s
      FROM t, g LEFT JOIN p ON p.user_id = t.user_id AND p.event_type = g.event_type)
"""


def _long(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return d.long_distance(d.long_shares(events, ["user_id"], "event_type"), d.long_shares(events, [], "event_type"), ["user_id"], "event_type")


#: Outcomes of a distribution that is handed to every task as a map.
MOST_IN_A_MAP = 10_000


def _maps(spark, sf_dir):
    """user_id, p and q: the user's and the overall shares as maps.  q has one row."""
    events = table(spark, sf_dir, "events")
    n = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.collect_list(F.struct("event_type", F.col("n").cast("double")))
    mine = n.groupBy("user_id").agg(d.probabilities(F.map_from_entries(entry)).alias("p"))
    every = n.groupBy("event_type").agg(F.sum("n").alias("n")).agg(d.probabilities(F.map_from_entries(entry)).alias("q"))
    return mine.join(F.broadcast(every))


@query(
    "D2 D3 D4 D15 A19 E21",
    f"WITH {_SHARES} SELECT user_id, total AS n, round(h, 6) AS hellinger, CASE WHEN h < 0.3 THEN 0 WHEN h < 0.6 THEN 1 ELSE 2 END AS class, CASE WHEN h < 0.3 THEN 'good' WHEN h < 0.6 THEN 'fair' ELSE 'poor' END AS class_name FROM (SELECT user_id, total, sqrt(0.5 * sum((sqrt(s) - sqrt(q)) ** 2)) AS h FROM u GROUP BY ALL)",
)
def hellinger_user_vs_global(spark, sf_dir):
    out = _long(spark, sf_dir)
    cls = d.distance_class(F.col("hellinger"))
    return out.select("user_id", "n", F.round("hellinger", 6).alias("hellinger"), cls.alias("class"), d.class_name(cls).alias("class_name"))


@query("D5", f"WITH {_SHARES} SELECT user_id, round(sum(abs(s - q)), 6) AS l1 FROM u GROUP BY 1")
def l1_user_vs_global(spark, sf_dir):
    return _long(spark, sf_dir).select("user_id", F.round("l1", 6).alias("l1"))


@query("D3 E18 D14 D17", f"WITH {_SHARES} SELECT user_id, round(h, 6) AS hellinger, round(1 - h, 6) AS fidelity FROM (SELECT user_id, sqrt(0.5 * sum((sqrt(s) - sqrt(q)) ** 2)) AS h FROM u GROUP BY 1)")
def hellinger_map_form(spark, sf_dir):
    """By maps where the overall distribution is small enough to be handed to every task; else as rows."""
    if table(spark, sf_dir, "events").select("event_type").distinct().limit(MOST_IN_A_MAP + 1).count() > MOST_IN_A_MAP:
        h = d.unit_interval(F.col("hellinger"))
        return _long(spark, sf_dir).select("user_id", F.round(h, 6).alias("hellinger"), F.round(1 - h, 6).alias("fidelity"))
    h = d.unit_interval(d.hellinger(F.col("p"), F.col("q")))
    return _maps(spark, sf_dir).select("user_id", F.round(h, 6).alias("hellinger"), F.round(1 - h, 6).alias("fidelity"))


_BITS = """
e AS (SELECT user_id, lpad(bin(round(coalesce(value, 0))::BIGINT % 4), 2, '0') AS k FROM events),
pc AS (SELECT user_id, k, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT user_id, k, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS s FROM pc),
g AS (SELECT k, sum(n) / (SELECT count(*)::DOUBLE FROM e) AS q FROM pc GROUP BY 1),
keys AS (SELECT DISTINCT k FROM e UNION SELECT DISTINCT reverse(k) FROM e),
us AS (SELECT DISTINCT user_id FROM e),
f AS (SELECT us.user_id, keys.k, coalesce(p.s, 0) AS s, coalesce(r.s, 0) AS rs, coalesce(g.q, 0) AS q
      FROM us CROSS JOIN keys LEFT JOIN p ON p.user_id = us.user_id AND p.k = keys.k
      LEFT JOIN p AS r ON r.user_id = us.user_id AND r.k = reverse(keys.k) LEFT JOIN g ON g.k = keys.k),
v AS (SELECT user_id, sum(abs(s - q)) AS a, sum(abs(rs - q)) AS b FROM f GROUP BY 1),
w AS (SELECT user_id, a, b, CASE WHEN abs(a - b) < 0.01 THEN 'uncertain' WHEN a <= b THEN 'normal' ELSE 'reversed' END AS verdict FROM v)
"""


def _bit_orders(spark, sf_dir):
    """Two-bit outcomes by user, and the distances of both reading orders to the overall distribution."""
    e = table(spark, sf_dir, "events").select("user_id", F.lpad(F.bin(F.round(F.coalesce("value", F.lit(0.0))).cast("long") % 4), 2, "0").alias("k"))
    n = e.groupBy("user_id", "k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    entry = F.collect_list(F.struct("k", "n"))
    mine = n.groupBy("user_id").agg(d.probabilities(F.map_from_entries(entry)).alias("p"))
    every = n.groupBy("k").agg(F.sum("n").alias("n")).agg(d.probabilities(F.map_from_entries(entry)).alias("q"))
    both = mine.join(F.broadcast(every)).select("user_id", d.l1(F.col("p"), F.col("q")).alias("a"), d.l1(d.reverse_keys(F.col("p")), F.col("q")).alias("b"))
    return both.withColumn("verdict", d.verdict(F.col("a"), F.col("b"), 0.01))


@query("D6 D7", f"WITH {_BITS} SELECT user_id, round(a, 6) AS straight, round(b, 6) AS turned, verdict FROM w")
def endianness_detect(spark, sf_dir):
    return _bit_orders(spark, sf_dir).select("user_id", F.round("a", 6).alias("straight"), F.round("b", 6).alias("turned"), "verdict")


@query(
    "D8 D9 D10",
    f"WITH {_BITS}, m AS (SELECT CASE WHEN count_if(verdict = 'normal') + count_if(verdict = 'reversed') = 0 THEN NULL WHEN count_if(verdict = 'normal') >= count_if(verdict = 'reversed') THEN 'normal' ELSE 'reversed' END AS dom FROM w) SELECT user_id, CASE WHEN verdict = 'uncertain' THEN coalesce(dom, 'normal') ELSE verdict END AS resolved, verdict = 'uncertain' AS used_fallback FROM w, m",
)
def dominant_mode_fallback(spark, sf_dir):
    rows = _bit_orders(spark, sf_dir)
    one = d.dominant(rows, ["verdict"])
    order, fallback = d.resolve_order(F.col("verdict"), F.lit(None).cast("string"), F.col("dominant_verdict"), F.col("dominant_all"))
    return rows.join(F.broadcast(one)).select("user_id", order.alias("resolved"), fallback.alias("used_fallback"))


@query(
    "D1 D2 D11 E13 B1 B2",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN '{\"k\":' || try_cast(json_extract_string(props, '$.k') AS BIGINT)::VARCHAR || '}' END AS again FROM events",
)
def counts_json_roundtrip(spark, sf_dir):
    # Twice encoded and a list of one, as stored payloads are.
    once = F.concat(F.lit("["), F.to_json(F.array(F.col("props"))), F.lit("]"))
    parsed = d.counts(F.get_json_object(once, "$[0][0]"))
    return table(spark, sf_dir, "events").withColumn("m", parsed).select("event_id", F.col("m")["k"].alias("k"), d.counts_json(F.col("m")).alias("again"))


@query(
    "D12 D13 J17",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'aligned' WHEN event_id % 3 = 1 THEN 'fallback:normal' ELSE 'fallback:reversed' END AS mode_used, CASE WHEN event_id % 3 = 0 THEN 'aligned:a' ELSE 'fallback:result+m' END AS source FROM events",
)
def result_source_choice(spark, sf_dir):
    a = F.when(F.col("event_id") % 3 == 0, F.col("props"))
    m = F.when(F.col("event_id") % 3 == 2, "reversed").otherwise("")
    _, mode, source = d.choose_source(a, F.col("props"), m, "a", "m")
    return table(spark, sf_dir, "events").select("event_id", mode.alias("mode_used"), source.alias("source"))
