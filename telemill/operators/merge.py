"""Joining measurements to executions, and choosing among repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from telemill.sources.io import quoted


def join_key(c: Column) -> Column:
    """Keys as trimmed text; null meets nothing."""
    return F.trim(c.cast("string"))


def pick_key(columns: list[str]) -> str:
    for name in ("parent_id", "id"):
        if name in columns:
            return name
    raise ValueError("no key column: parent_id or id")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """The first or last row of each key in a total order (ascending, nulls first); ``none`` keeps all.

    An aggregation that combines before it shuffles, so a key with very many rows isn't one task's work.
    """
    if keep == "none":
        return df
    if keep not in ("first", "last"):
        raise ValueError("keep is first, last or none")
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    return df.groupBy(*[F.col(quoted(k)).alias(f"__{k}") for k in keys]).agg(pick(row, F.struct(*order)).alias("__row")).select("__row.*")


def mean_or_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: means of numbers, first value that isn't null (in order) of everything else."""
    out = []
    for f in df.schema:
        if f.name in keys:
            continue
        c = F.col(quoted(f.name))
        first = F.min_by(c, F.when(c.isNotNull(), order))
        out.append((F.avg(c) if isinstance(f.dataType, NumericType) else first).alias(f.name))
    return df.groupBy(*keys).agg(*out)


def merge_sensors(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column] | None = None, keep: str = "first") -> DataFrame:
    """Left join with ``sensor_merge_found``; the right key becomes sensor_source_id.

    Columns that both sides have stay the left side's.  Before the join the right side is reduced to the keys that
    the left side has and, unless ``keep`` is none, to one row for each.
    """
    right = right.drop(*[c for c in right.columns if c in set(left.columns) and c != right_key])
    right = right.withColumn("sensor_source_id", join_key(F.col(quoted(right_key))))
    if right_key != "sensor_source_id":
        right = right.drop(right_key)
    right = right.where("sensor_source_id is not null")
    keyed = left.withColumn("__key", join_key(F.col(quoted(left_key))))
    right = right.join(keyed.select("__key").distinct(), F.col("sensor_source_id") == F.col("__key"), "left_semi")
    if keep != "none":
        right = one_per_key(right, ["sensor_source_id"], order or [F.col(quoted(c)) for c in right.columns], keep)
    joined = keyed.join(right, F.col("__key") == F.col("sensor_source_id"), "left").drop("__key")
    return joined.withColumn("sensor_merge_found", F.col("sensor_source_id").isNotNull())


def match_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if("sensor_merge_found").alias("matched"), F.count_if(~F.col("sensor_merge_found")).alias("unmatched"))


def drop_groups_with(df: DataFrame, group: str, bad: Column) -> DataFrame:
    """Without any row of a group that has one bad row."""
    return df.join(df.where(bad).select(group).distinct(), group, "left_anti")


def first_success(candidates: list[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """(value, name of its source, used_fallback) of the first candidate that isn't null."""
    value = F.coalesce(*[c for _, c in candidates])
    name = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in candidates])
    return value, name, F.coalesce(name != candidates[0][0], F.lit(False))


def attempts(candidates: list[tuple[str, Column]]) -> Column:
    """How many candidates were tried: up to the first that isn't null, or all."""
    first = F.coalesce(*[F.when(c.isNotNull(), k) for k, (_, c) in enumerate(candidates, 1)], F.lit(len(candidates)))
    return first.cast("long")
