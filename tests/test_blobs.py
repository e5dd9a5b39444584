"""The blob store: what is read doesn't grow with it, writers don't meet, and compaction loses nothing."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from telemill.sources import blobs


def docs(spark, first, last):
    return blobs.blobs(spark.range(first, last).select(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("t")), "t", "native")


def bytes_read(spark, f):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, total = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            total += store.lastStageAttempt(stage).inputBytes()
    return total


def test_reads_dont_grow_with_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "DIGITS", 1)
    # Vectored reads of local files aren't counted.
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")
    sizes, lookups, inserts = (800, 40_000), [], []
    for n in sizes:
        path = str(tmp_path / f"s{n}")
        assert blobs.insert_ignore(spark, docs(spark, 0, n), path) == n
        ref = docs(spark, 7, 8).first().ref
        got = []
        lookups.append(bytes_read(spark, lambda path=path, ref=ref, got=got: got.append(blobs.load(spark, path, ref))))
        assert got[0].startswith("text ")
        assert blobs.load(spark, path, "native:" + "f" * 64) is None
        ten = docs(spark, n - 5, n + 5)
        inserts.append(bytes_read(spark, lambda path=path, ten=ten: blobs.insert_ignore(spark, ten, path)))
        assert blobs.stored(spark, path).count() == n + 5
    # Fifty times the rows: footers and page indexes grow a little, what is read of the rows doesn't.
    assert lookups[1] < 8 * lookups[0] and inserts[1] < 8 * inserts[0]
    whole = bytes_read(spark, lambda: blobs.stored(spark, str(tmp_path / "s40000")).agg(F.sum(F.length("blob"))).collect())
    spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.hadoop.vectored.io.enabled")
    assert lookups[1] < whole / 30 and inserts[1] < whole / 3


def test_two_writers_leave_one_row(spark, tmp_path):
    path, failed = str(tmp_path / "both"), []

    def insert(first, last):
        try:
            blobs.insert_ignore(spark, docs(spark, first, last), path)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=insert, args=a) for a in ((0, 300), (100, 400), (0, 400))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    rows = spark.read.schema(blobs.SCHEMA).parquet(path)
    assert rows.count() == 400 == rows.select("ref").distinct().count()


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "DIGITS", 1)
    monkeypatch.setattr(blobs, "MOST_FILES", 2)
    path = str(tmp_path / "many")
    for k in range(4):
        blobs.insert_ignore(spark, docs(spark, 0, 100 * (k + 1)), path)
    before = sorted(r.ref for r in blobs.stored(spark, path).collect())
    assert blobs.compact(spark, path) == 16 and blobs.compact(spark, path) == 0
    assert sorted(r.ref for r in spark.read.schema(blobs.SCHEMA).parquet(path).collect()) == before
    assert len(list((tmp_path / "many").glob("shard=0/*.parquet"))) == 1 and not list((tmp_path / "many").glob("_compacted*"))


def test_a_lock_left_behind(spark, tmp_path, monkeypatch):
    path = tmp_path / "left"
    path.mkdir()
    (path / "_lock").write_text("someone else")
    monkeypatch.setattr(blobs, "WAIT", 0.5)
    with pytest.raises(TimeoutError):
        blobs.insert_ignore(spark, docs(spark, 0, 3), str(path))
    monkeypatch.setattr(blobs, "STALE", -1)
    assert blobs.insert_ignore(spark, docs(spark, 0, 3), str(path)) == 3 and not (path / "_lock").exists()
