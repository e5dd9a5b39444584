import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from telemill.llm import meetings, workspace


def test_frequent_keys_are_never_missing():
    rng = random.Random(1)
    for most in (3, 10, 50):
        f, true = meetings.Frequent(most), Counter()
        for _ in range(200):
            keys = [rng.randrange(5) if rng.random() < 0.4 else rng.randrange(10**6) for _ in range(rng.randrange(0, 300))]
            true.update(keys)
            f.add(np.array(keys, dtype=np.uint64))
            if rng.random() < 0.2:
                f._merge()
        keys, counts, total = f.result()
        got = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert total == sum(true.values()) and len(got) <= most
        assert all(got.get(k, 0) <= n and got.get(k, 0) >= n - total / most for k, n in true.items())


def test_shared_keys_equal_plain_grouping(spark, monkeypatch):
    monkeypatch.setattr(meetings, "BUCKET", 300)
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 62) if rng.random() < 0.5 else rng.randrange(40) << 40, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, value long").repartition(5)

    def pairs_of(part: pa.RecordBatch):
        return part["key"].to_numpy().view(np.uint64), part["value"].to_numpy().view(np.uint64)

    def found(keys, values):
        assert (np.diff(keys.view(np.int64)) >= 0).all()
        return {"key": keys.view(np.int64), "value": values.view(np.int64)}

    out = meetings.shared_keys(df, pairs_of, len(rows), lambda k, v: (k, v), found, "key long, value long").collect()
    n = Counter(k for k, _ in rows)
    assert sorted(map(tuple, out)) == sorted(r for r in rows if n[r[0]] > 1)
    assert meetings.shared_keys(df.where("false"), pairs_of, 0, lambda k, v: (k, v), found, "key long, value long").count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_marks_have_no_false_negatives(spark, bits):
    from pyspark.sql import functions as F

    df = spark.range(500).select((F.col("id") * 7919 - 1_000_000).alias("k"), F.lit("mine").alias("word"), F.lit("mine").alias("bits"))
    wanted = df.where("k % 11 = 0")
    words = workspace.marks(wanted, F.col("k"), bits)
    assert words.count() <= bits // 64
    hits, rest = workspace.split_by_marks(df, df["k"], words, bits)
    a, b = ({r.k for r in x.collect()} for x in (hits, rest))
    every = {r.k for r in df.collect()}
    assert a | b == every and not a & b and {r.k for r in wanted.collect()} <= a and hits.columns == df.columns
    array = workspace.bitmap(words, bits)
    keys = np.array(sorted(every))
    assert set(keys[workspace.in_bitmap(array, keys)].tolist()) == a
