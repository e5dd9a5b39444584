"""The Merkle manifest against plain trees, its monoid under any bracketing, and awkward rows."""

import hashlib
import random
import zlib

import pytest
from edges import clashing_docs, edge_docs, empty_docs, table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from oracles import connect, oracle_rows, rows_of
from pyspark.sql import functions as F

from conftest import DATA
from telemill.llm import merkle, queries


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return h([field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(None if r["n_chars"] is None else r["n_chars"] + more), field(r["text"])])


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels_of([leaf(r) for r in langs[x]]) for x in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            struck = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, beside = leaf(r, int(struck)), []
            for levels, k in ((trees[g], i), (top, g)):
                for level in levels[:-1]:
                    others = [level[k ^ 1]] if k ^ 1 < len(level) else []
                    beside += others
                    now = h([*others, now] if k % 2 else [now, *others])
                    k //= 2
            out.append(tuple(str(v) for v in (r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(beside), now, now == top[-1][0])))
    return sorted(out)


@pytest.mark.parametrize(("stretch", "fan"), [(8192, 32), (5, 3), (1, 2)])
def test_equals_plain_trees(spark, monkeypatch, stretch, fan):
    monkeypatch.setattr(merkle, "STRETCH", stretch)
    monkeypatch.setattr(merkle, "FAN", fan)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert table_of(merkle.manifest(docs)) == plain([r.asDict() for r in docs.collect()])


def test_query_equals_oracle(spark):
    name = "op12_merkle_manifest"
    assert rows_of(queries.QUERIES[name](spark, f"{DATA}/sf0.01")) == oracle_rows(connect(f"{DATA}/sf0.01"), queries.ORACLES[name])


def test_awkward_rows(spark):
    docs = edge_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    for some in (docs, docs.withColumn("lang", F.when(F.col("doc_id") > 3, "é").when(F.col("doc_id") == 2, "zz")), docs.withColumn("lang", F.col("doc_id").cast("string")), docs.where("doc_id = 3")):
        assert table_of(merkle.manifest(some)) == plain([r.asDict() for r in some.collect()])
    assert table_of(merkle.manifest(clashing_docs(spark))) == table_of(merkle.manifest(edge_docs(spark)))
    assert merkle.manifest(empty_docs(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_forests_merge_associatively(counts, rnd):
    sizes = {merkle.TOP: len(counts)} | dict(enumerate(counts))
    nodes = [((t, 0, k), h([f"{t}/{k}"]).encode()) for t, n in enumerate(counts) for k in range(n)]
    rnd.shuffle(nodes)
    parts = [dict([x]) for x in nodes]
    while len(parts) > 1:
        at = rnd.randrange(len(parts) - 1)
        parts[at : at + 2] = [merkle.merge(parts[at], parts[at + 1], sizes)]
    trees = [levels_of([h([f"{t}/{k}"]) for k in range(n)]) for t, n in enumerate(counts)]
    assert list(parts[0].values()) == [levels_of([t[-1][0] for t in trees])[-1][0].encode()]


def test_any_change_is_seen(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in merkle.manifest(docs).collect()}
    struck = {k for k in out if zlib.crc32(str(k).encode()) % 7 == 0}
    assert struck and {k for k, r in out.items() if not r.verified} == struck
    row = random.Random(3).choice(docs.where("text is not null").collect())
    other = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == row.doc_id, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    assert {r.root for r in other.collect()} != {r.root for r in out.values()}
