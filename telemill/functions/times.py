"""Times: local to UTC, order of events, age, months and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_utc(text: Column, zone: str = "Europe/Berlin") -> Column:
    """Naive local times to UTC (the earlier one in an autumn overlap, shifted on in a spring gap).

    Times that name their offset keep it.
    """
    t = F.trim(text)
    aware = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    zoned = F.try_to_timestamp(t)
    return F.when(aware, zoned).otherwise(F.to_utc_timestamp(t.try_cast("timestamp_ntz"), zone))


def not_after(scheduled: Column, completed: Column, seconds: int = 1) -> Column:
    """``scheduled``, unless it lies more than ``seconds`` after ``completed``."""
    return F.when(~F.coalesce(scheduled > completed + F.make_interval(secs=F.lit(seconds)), F.lit(False)), scheduled)


def age_hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All months from first to last (yyyy-MM), one row each."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("day")).select(month(F.col("day")).alias("month"))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """All months between the first and the last time in ``df``: one row at a time from two numbers."""
    ends = df.agg(F.trunc(F.min(ts), "month").alias("a"), F.trunc(F.max(ts), "month").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("day")).select(month(F.col("day")).alias("month"))
