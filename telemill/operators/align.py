"""Aligning series of measurements with executions in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ("mean", "min", "max", "sd", "count")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _ends_of_windows(rows: DataFrame, by: list[str], payload: list[str], prefix: str) -> DataFrame:
    """(payload, statistics) of rows of (by, __block, __t, __kind, __rid, __v, payload) of three kinds.

    Time is cut into blocks of one window's length, so a window is the end of one block and the beginning of the next.
    Kind 0 is a reading; kind 1 asks at its time for the readings of its block so far; kind -1 asks, one window earlier
    and so in the block before, for those from there to the block's end.  Both are frames that only grow, which Spark
    adds up once, and no reading is handed to a second block.  The two answers of an ask are merged by counts, means and
    squared deviations, so nothing is subtracted and large offsets do no harm.
    """
    parts = Window.partitionBy(*by, "__block")
    begin = parts.orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    end = parts.orderBy(F.col("__t").desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("__kind") == 1
    told = lambda f: F.when(first, f.over(begin)).otherwise(f.over(end))
    stats = rows.withColumns({"__n": told(F.count("__v")), "__m": told(F.avg("__v")), "__d": told(F.var_pop("__v")), "__a": told(F.min("__v")), "__z": told(F.max("__v")), "__seen": told(F.count_if(F.col("__kind") == 0))})
    side = lambda kind, c: F.max(F.when(F.col("__kind") == kind, F.col(c)))
    both = stats.where("__kind != 0").groupBy("__rid").agg(
        F.sum("__n").alias("__n"), F.sum("__seen").alias("__seen"), F.min("__a").alias("__a"), F.max("__z").alias("__z"),
        *[side(k, c).alias(f"{c}{i}") for i, k in enumerate((1, -1)) for c in ("__n", "__m", "__d")], *[F.max_by(F.struct(c), F.col("__kind")).alias(c) for c in payload],
    )
    n0, n1 = (F.coalesce(F.col(f"__n{i}"), F.lit(0)).cast("double") for i in (0, 1))
    m0, m1, d0, d1 = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("__m0", "__m1", "__d0", "__d1"))
    n = F.nullif(n0 + n1, F.lit(0.0))
    mean = (n0 * m0 + n1 * m1) / n
    squares = d0 * n0 + d1 * n1 + (m0 - m1) * (m0 - m1) * n0 * n1 / n
    values = {"mean": mean, "min": F.col("__a"), "max": F.col("__z"), "sd": F.when(n > 1, F.sqrt(squares / (n - 1))), "count": F.coalesce(F.col("__n"), F.lit(0))}
    return both.select(*[F.col(c)[c].alias(c) for c in payload], *[values[k].alias(f"{prefix}__{k}") for k in STATISTICS], "__seen")


def trailing_window(df: DataFrame, series: str, ts: str, value: str, seconds: int, prefix: str = "w") -> DataFrame:
    """Per row, mean, min, max, sd and count of its series' values in the last ``seconds`` up to its own time.

    A row without a time has no window (count 0) and is in none.  The work grows with the rows, however many of them a
    window holds, and a long series is many tasks' work; see ``_ends_of_windows``.
    """
    step = seconds * 1_000_000
    t = _micros(F.col(ts))
    kinds = [F.struct(F.lit(k).alias("kind"), (t - (0 if k >= 0 else step)).alias("t")) for k in (0, 1, -1)]
    # The number first: a row's copies share it.
    rows = df.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__k", F.explode(F.array(*kinds)))
    rows = rows.withColumns({"__kind": F.col("__k.kind"), "__t": F.col("__k.t"), "__v": F.when((F.col("__k.kind") == 0) & F.col("__k.t").isNotNull(), F.col(value).cast("double"))})
    rows = rows.withColumns({"__block": F.col("__t") - F.pmod("__t", F.lit(step)), "__series": F.col(series)})
    kept = {c: F.when(F.col("__kind") == 1, F.col(c)).alias(c) for c in df.columns}
    narrow = rows.select("__series", "__block", "__t", "__kind", "__rid", "__v", *kept.values())
    return _ends_of_windows(narrow, ["__series"], df.columns, prefix).drop("__seen")


def window_statistics(anchors: DataFrame, readings: DataFrame, on: list[str], anchor_id: str, anchor_ts: str, ts: str, value: str, seconds: int, prefix: str = "w") -> DataFrame:
    """(on, anchor_id, statistics) of the readings in [anchor - seconds, anchor].

    Anchors without any reading, without a time or without a key are absent.  The work grows with the rows, not with
    pairs; see ``_ends_of_windows``.
    """
    step = seconds * 1_000_000
    t = _micros(F.col(anchor_ts))
    kinds = [F.struct(F.lit(k).alias("kind"), (t - (0 if k > 0 else step)).alias("t")) for k in (1, -1)]
    a = anchors.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__k", F.explode(F.array(*kinds))).select(*on, anchor_id, "__rid", F.col("__k.kind").alias("__kind"), F.col("__k.t").alias("__t"))
    r = readings.select(*on, F.lit(0).alias("__kind"), _micros(F.col(ts)).alias("__t"), F.col(value).cast("double").alias("__v"))
    known = F.col("__t").isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    rows = a.unionByName(r, allowMissingColumns=True).where(known).withColumn("__block", F.col("__t") - F.pmod("__t", F.lit(step)))
    return _ends_of_windows(rows, on, [*on, anchor_id], prefix).where("__seen > 0").drop("__seen")


def latest_before(anchors: DataFrame, samples: DataFrame, on: list[str], anchor_id: str, anchor_ts: str, ts: str, value: str, hours: float) -> DataFrame:
    """As-of join: anchors with the latest sample not after them, unless it is older than ``hours`` (then null).

    Time is cut into slots of that age: what counts for an anchor lies in its own slot or is the last sample of the one
    before, which is handed on.  Anchors and samples of a key and slot are united and sorted once, and the last sample
    so far is carried forward.  So the work grows with the rows, not with pairs, and a long series is many tasks' work.
    Of samples at one time the largest value counts.
    """
    step = int(hours * 3_600_000_000)
    keep = [c for c in anchors.columns if c not in (*on, anchor_id, anchor_ts)]
    slot = F.floor(F.col("__t") / step).alias("__slot")
    a = anchors.select(*on, _micros(F.col(anchor_ts)).alias("__t"), F.lit(1).alias("__is"), F.struct(anchor_id, anchor_ts, *keep).alias("__row")).select("*", slot)
    s = samples.where(F.col(value).isNotNull()).select(*on, _micros(F.col(ts)).alias("__t"), F.struct(_micros(F.col(ts)).alias("t"), F.col(value).alias("v")).alias("__s")).select("*", slot)
    handed = s.groupBy(*on, "__slot").agg(F.max("__s").alias("__s")).select(*on, F.col("__s.t").alias("__t"), "__s", (F.col("__slot") + 1).alias("__slot"))
    both = a.unionByName(s.unionByName(handed).withColumn("__is", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*on, "__slot").orderBy("__t", "__is", F.col("__s.v")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__s", ignorenulls=True).over(w)).where("__is = 1")
    age = (F.col("__t") - F.col("__last.t")) / F.lit(3.6e9)
    fresh = age <= hours
    return both.select(*on, "__row.*", F.when(fresh, F.col("__last.v")).alias(f"{value}__asof"), F.when(fresh, age).alias(f"{value}__age_hours"))
