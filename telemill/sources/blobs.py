"""A store of contents by hash: Parquet files by the beginning of the hash, with one row for each distinct content.

A hash is evenly spread, so its first digits part the store into folders of like size.  Within a file rows are sorted by
reference and pages are small, so a lookup reads one folder's footers and the page that may hold the reference, and an
insert reads no other folders than those of its new references.  Writers take turns by a lock file; readers need none.
"""

from __future__ import annotations

import gzip
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

SCHEMA = "ref string, content_hash string, kind string, encoding string, blob binary, nbytes long"
#: Digits of the hash that name a folder; new references that are looked up by value; files of a folder before it is compacted.
DIGITS, FEW, MOST_FILES = 2, 1000, 8
#: How long a writer waits for its turn, and after how many seconds a lock counts as left behind.
WAIT, STALE = 600, 3600
#: Small pages with statistics and a filter on the reference.
LAYOUT = {"compression": "zstd", "parquet.page.row.count.limit": "256", "parquet.block.size": str(32 << 20), "parquet.bloom.filter.enabled#ref": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 16)}


def reference(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha2(text, 256))


def packed(texts: pd.Series) -> pd.Series:
    """gzip with a fixed time stamp, so equal texts give equal bytes."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))


def blobs(df: DataFrame, text: str, kind: str) -> DataFrame:
    """One row for each distinct text, compressed once."""
    distinct = df.select(F.col(text).alias("text")).where("text is not null and trim(text) != ''").distinct()
    return distinct.select(reference(kind, F.col("text")).alias("ref"), F.sha2("text", 256).alias("content_hash"), F.lit(kind).alias("kind"), F.lit("gzip").alias("encoding"), F.pandas_udf(packed, "binary")("text").alias("blob"), F.octet_length("text").cast("long").alias("nbytes"))


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its constructor of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """A writer's turn: a file that only one can create, with its name in it, as some file systems let two through."""
    fs, make = _files(spark, path)
    lock, name, began = make(f"{path}/_lock"), uuid.uuid4().hex, time.monotonic()
    fs.mkdirs(make(path))
    while True:
        try:
            out = fs.create(lock, False)
            out.writeBytes(name)
            out.close()
            time.sleep(0.05)
            if _content(fs, lock) == name:
                break
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
        if fs.exists(lock) and time.time() * 1000 - fs.getFileStatus(lock).getModificationTime() > STALE * 1000:
            fs.delete(lock, False)
        if time.monotonic() - began > WAIT:
            raise TimeoutError(f"{path} stays locked")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(lock, False)


def _content(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def folder(ref: Column) -> Column:
    """The first digits of a reference's hash."""
    return F.substring(F.substring_index(ref, ":", -1), 1, DIGITS)


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame | None:
    """The rows of some folders; None if none of them exists."""
    fs, make = _files(spark, path)
    there = [where for f in folders if fs.exists(make(where := f"{path}/shard={f}"))]
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(*there) if there else None


def _write(rows: DataFrame, path: str) -> None:
    dealt = rows.withColumn("shard", folder(F.col("ref"))).repartition("shard").sortWithinPartitions("shard", "ref")
    dealt.write.mode("append").partitionBy("shard").options(**LAYOUT).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store, one for each reference even while a compaction is under way."""
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path).dropDuplicates(["ref"])


def insert_ignore(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Append what the store doesn't have yet, and tell how many rows that was; only folders of new references are read.

    Contents are compressed before the writer's turn comes.  A job that dies leaves the store as it was, and its lock,
    which others remove after an hour.
    """
    new = written(new.dropDuplicates(["ref"]), "new-blobs")
    folders = [r[0] for r in new.select(folder(F.col("ref")).alias("f")).distinct().collect()]
    with locked(spark, path):
        if (have := _read(spark, path, folders)) is not None:
            refs = [r[0] for r in new.select("ref").limit(FEW + 1).collect()]
            have = have.select("ref") if len(refs) > FEW else have.select("ref").where(F.col("ref").isin(refs))
            new = written(new.join(have, "ref", "left_anti"), "new-blobs")
        added = new.count()
        if added:
            _write(new, path)
    return added


def load(spark: SparkSession, path: str, ref: str) -> str | None:
    """The content of a reference, from one folder's matching page; None if the store doesn't have it."""
    have = _read(spark, path, [ref.rpartition(":")[2][:DIGITS]])
    row = None if have is None else have.where(F.col("ref") == ref).select("blob").first()
    return None if row is None else gzip.decompress(bytes(row.blob)).decode()


def compact(spark: SparkSession, path: str) -> int:
    """Make one file of each folder that has more than a few, and tell how many folders that were.

    The new file is moved in before the old ones go, so a reader finds each row once or twice, but never not at all; one
    that has planned its reading with the old files has to plan it again.
    """
    fs, make = _files(spark, path)
    done = 0
    with locked(spark, path):
        for status in fs.listStatus(make(path)):
            where = status.getPath()
            files = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")] if status.isDirectory() and where.getName().startswith("shard=") else []
            if len(files) <= MOST_FILES:
                continue
            beside = f"{path}/_compacted-{uuid.uuid4().hex}"
            rows = spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(where.toString()).dropDuplicates(["ref"])
            rows.repartition(1).sortWithinPartitions("ref").write.options(**LAYOUT).parquet(beside)
            for f in fs.listStatus(make(beside)):
                if f.getPath().getName().endswith(".parquet"):
                    fs.rename(f.getPath(), make(f"{where.toString()}/{f.getPath().getName()}"))
            for f in files:
                fs.delete(f, False)
            fs.delete(make(beside), True)
            done += 1
    return done
