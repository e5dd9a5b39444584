"""Reproducible shuffle and sharding: a Feistel permutation of global row numbers.

Every row gets a global number (its place in the order of document id, text checksum and size), the number is permuted
over 0..N-1, and the permuted place p is row ``p // shards`` of shard ``p % shards``.  Shard and slot of any row can so
be computed from (row number, N, seed) alone, and shard sizes differ by one row at most (the ``rows`` law).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feistel import ArrayPermutation
from .workspace import materialise


def number_rows(df: DataFrame, order: list[Column | str], name: str, number: str = "row_no") -> tuple[DataFrame, int]:
    """Add a gapless global row number in the given order; returns the (written) table and its number of rows.

    Rows are range-partitioned and sorted; ties are broken by their place in the input, so that a value which a third
    of all rows share is still dealt over several partitions.  Which of two identical rows comes first does not change
    the set of results.  The table is written once, so that no later recomputation can deal it otherwise.
    """
    tie = "__tie"
    parts = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"))
    )
    parts = materialise(parts, name)
    # One row a partition: bounded by the number of partitions, whatever the data.
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    total = parts.count()
    numbered = parts.join(F.broadcast(starts), "__part").withColumn(number, F.col("__start") + F.col("__pos"))
    return numbered.drop("__part", "__pos", "__start"), total


SHARDS, SEED = 16, 20240607


def round_keys(seed: int = SEED) -> list[int]:
    """The permutation's round keys, by which anyone can compute a row's place."""
    return [int(k) for k in ArrayPermutation(0, seed).keys]


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_no, place, shard and slot of every row of ``docs`` (columns doc_id and text).

    A null text counts as empty (size 1, checksum 0); repeated rows and null or repeated ids are rows like any other;
    an empty table gives an empty result; further columns are ignored.  The same rows get the same shards and slots
    however they are partitioned.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered, total = number_rows(small, ["doc_id", "text_crc32", "size"], "shard-rows")

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(ArrayPermutation(total, seed)(rows.to_numpy()))

    placed = numbered.withColumn("place", place("row_no"))
    return placed.withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("place") / F.lit(shards)).cast("long")})
