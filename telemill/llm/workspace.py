"""Shared storage for intermediate tables, and small helpers that all operators use.

Lineage is cut by writing a Parquet table below the folder named by ``spark.checkpoint.dir``, which every executor can
read: a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.sources.io import quoted
from telemill.sources.scratch import shared_folder

#: Bits of a bitmap of keys that is handed to every executor, whatever the number of keys.
MARKS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with a short lineage and unchanged schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/telemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with names that no other table has, and its columns by their old names."""
    tag = uuid.uuid4().hex
    out = df.select(*[F.col(c).alias(f"{c}_{tag}") for c in df.columns])
    return out, {c: F.col(f"{c}_{tag}") for c in df.columns}


def marks(keys: DataFrame, key: Column, bits: int = MARKS) -> DataFrame:
    """(word, bits) of a bitmap in which the place of each key is set: ``bits / 64`` rows at most.

    A key whose place isn't set is not among the keys; one whose place is set probably is.  The more keys there are, the
    less the bitmap leaves out, but it never grows.
    """
    place = F.pmod(key, F.lit(bits))
    words = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def split_by_marks(df: DataFrame, key: Column, words: DataFrame, bits: int = MARKS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key has its place set, and the others; neither is shuffled."""
    place = F.pmod(key, F.lit(bits))
    words, word = renamed(words)
    joined = df.join(F.broadcast(words), F.shiftright(place, 6) == word["word"], "left")
    hit = F.coalesce(F.getbit(word["bits"], place.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    columns = [df[quoted(c)] for c in df.columns]
    return joined.where(hit).select(*columns), joined.where(~hit).select(*columns)


def bitmap(words: DataFrame, bits: int = MARKS) -> np.ndarray:
    """The bitmap of ``marks`` as an array of bytes (``bits / 8`` of them)."""
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (signed 64-bit) keys have their place set."""
    place = np.mod(keys, len(array) * 8)
    return (array[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def clear(spark: SparkSession) -> None:
    """Remove all tables that ``materialise`` has left in the shared folder; results that still read them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/telemill")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(texts: list, max_bytes: int = 4 << 20):
    """Yield (start, stop) ranges whose texts together have about ``max_bytes``; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
