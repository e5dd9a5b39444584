"""Choosing the rows that an analysis uses, and accounting for those it doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.times import month
from telemill.sources.io import quoted

from .quality import any_of

STALE_HOURS = 48.0


def month_pool(df: DataFrame, ts: str, first: str | None = None, without: list[str] = ()) -> DataFrame:
    """Rows from a month (yyyy-MM) on, less some months; months compare as text."""
    m = month(F.col(ts))
    if first:
        df = df.where(m >= first)
    return df.where(~m.isin(*without)) if without else df


def measured(columns: list[str]) -> Column:
    return any_of([F.col(quoted(c)).isNotNull() for c in columns])


def fill_share(columns: list[str]) -> Column:
    return sum((F.col(quoted(c)).isNotNull().cast("double") for c in columns[1:]), F.col(quoted(columns[0])).isNotNull().cast("double")) / len(columns)


def available(sensors: list[str], calibration: list[str], age: Column | None) -> Column:
    """Any sensor value and, if the device has calibration, a calibration value that isn't stale (null age is)."""
    ok = measured(sensors)
    if calibration:
        ok = ok & measured(calibration) & F.coalesce(age <= STALE_HOURS, F.lit(False))
    return ok


def in_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def check_unique(df: DataFrame, column: str) -> None:
    if df.groupBy(column).count().where("count > 1").limit(1).count():
        raise ValueError(f"{column} isn't unique")


def funnel(df: DataFrame, steps: list[tuple[str, Column]], ts: str, top: int = 3) -> DataFrame:
    """step, name, rows left, removed, share of all in percent, and the months that lost most ("2024-01: 5, ...").

    A row passes a step if it passed all before and the step's condition is true.  One aggregation by month and number
    of steps passed has everything else.
    """
    passed = F.lit(0)
    alive = F.lit(True)
    for _, c in steps:
        alive = alive & F.coalesce(c, F.lit(False))
        passed = passed + alive.cast("int")
    by = df.select(month(F.col(ts)).alias("month"), passed.alias("passed")).groupBy("month", "passed").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("name")) for k, (name, _) in enumerate([("all", None), *steps])])
    long = by.select("month", "passed", "n", F.explode(names).alias("s")).select("month", "passed", "n", "s.*")
    left, lost = F.when(F.col("passed") >= F.col("step"), F.col("n")).otherwise(0), F.when(F.col("passed") == F.col("step") - 1, F.col("n")).otherwise(0)
    months = long.groupBy("step", "name", "month").agg(F.sum(left).alias("rows"), F.sum(lost).alias("removed"))
    rank = Window.partitionBy("step").orderBy(F.desc("removed"), "month")
    months = months.withColumn("rank", F.row_number().over(rank))
    worst = F.filter(F.array_sort(F.collect_list(F.struct("rank", "month", "removed"))), lambda x: (x["removed"] > 0) & (x["rank"] <= top))
    texts = F.transform(worst, lambda x: F.concat(x["month"], F.lit(": "), x["removed"].cast("string")))
    out = months.groupBy("step", "name").agg(F.sum("rows").alias("rows"), F.sum("removed").alias("removed"), F.array_join(texts, ", ").alias("why"), F.count_if(F.col("removed") > 0).alias("months"))
    total = F.max(F.when(F.col("step") == 0, F.col("rows"))).over(Window.partitionBy(F.lit(1)))
    why = F.when(F.col("months") > top, F.concat("why", F.lit(" +"), (F.col("months") - top).cast("string"), F.lit(" more months"))).otherwise(F.col("why"))
    return out.select("step", "name", "rows", "removed", F.round(100.0 * F.try_divide(F.col("rows").cast("double"), total.cast("double")), 1).alias("share"), why.alias("why"))


def memberships(df: DataFrame, pools: dict[str, Column], target: Column) -> DataFrame:
    """pool, rows, rows with a target: one pass."""
    wide = df.agg(*[x for k, c in enumerate(pools.values()) for x in (F.count_if(c).alias(f"n{k}"), F.count_if(c & target.isNotNull()).alias(f"t{k}"))])
    rows = F.array(*[F.struct(F.lit(p).alias("pool"), F.col(f"n{k}").alias("rows"), F.col(f"t{k}").alias("with_target")) for k, p in enumerate(pools)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def device_codes(df: DataFrame, device: str) -> DataFrame:
    """(device, device_encoded) in sorted order; one row a device."""
    names = df.select(device).where(F.col(device).isNotNull()).distinct()
    return names.withColumn("device_encoded", (F.row_number().over(Window.orderBy(device)) - 1).cast("int"))
