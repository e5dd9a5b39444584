"""Spelling variants against brute force and SQL, words full of equal bigrams, hot keys, and awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edges import clashing_docs, edge_docs, empty_docs, table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from oracles import connect, oracle_rows, rows_of

from conftest import DATA
from telemill.llm import queries, spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(docs, least=7, often=2):
    totals = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                totals[run] += 1
    n = {w: k for w, k in totals.items() if k >= often}
    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(tuple(map(str, (w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None))) for w in n)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_oracle(spark, size):
    name = "op11_spelling_variants"
    assert rows_of(queries.QUERIES[name](spark, f"{DATA}/{size}")) == oracle_rows(connect(f"{DATA}/{size}"), queries.ORACLES[name])


def chained(rnd):
    """Words with forms of forms, repeats of few letters, and letters beyond ASCII."""
    rows, base = [], ["abababab", "aaaaaaaa", "wortspiel", "résuméés", "ÿÿÿÿÿÿÿ", "xyxyxyxz"]
    for w in base:
        for k, copies in ((0, 1200), (1, 90), (2, 6)):
            x = w
            for _ in range(k):
                at = rnd.randrange(len(x) + 1)
                x = rnd.choice([x[:at] + rnd.choice("abxyé") + x[at:], x[:at] + rnd.choice("abxyé") + x[at + 1 :], x[:at] + x[at + 1 :] + "a"])
            rows.append((rnd.randrange(10**6), f"{x.upper()}. {x}-" * copies))
    return rows


@pytest.mark.parametrize("hot", [256, 1])
def test_chains_and_equal_bigrams(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rnd = random.Random(11)
    rows = chained(rnd) + [(k, " ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 11))) for _ in range(60))) for k in range(12)]
    got = table_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert any(r[1] != "None" and r[1] != r[2] for r in got)


@settings(max_examples=600, deadline=None)
@given(st.text("abc", min_size=7, max_size=14), st.integers(0, 13), st.sampled_from("abcd"), st.sampled_from(["put", "take", "change"]), st.integers(0, 10**6))
def test_neighbours_share_a_rare_bigram_and_a_side(word, at, letter, edit, seed):
    at = min(at, len(word) - 1)
    other = {"put": word[:at] + letter + word[at:], "take": word[:at] + word[at + 1 :], "change": word[:at] + letter + word[at + 1 :]}[edit]
    ranks = np.random.RandomState(seed).permutation(spelling.GRAMS)
    keys = []
    for w, places in zip((word, other), spelling.rarest([word, other], ranks), strict=True):
        keys.append({("<", w[: p + 2]) for p in places} | {(">", w[p:]) for p in places})
    assert len(other) < 7 or keys[0] & keys[1]


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert table_of(spelling.variants(edge_docs(spark))) == brute(rows)
    assert table_of(spelling.variants(clashing_docs(spark))) == brute(rows)
    assert spelling.variants(empty_docs(spark)).collect() == []
    long_word = "q" * 300_000
    rows = [(1, f"{long_word} {long_word[:-1]}"), (2, f"{long_word} {long_word[:-1]}"), (None, "unterwegs unterwegs"), (None, None)]
    assert [r[4] for r in table_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))] == ["1", "1", "0"]


@pytest.mark.parametrize("long", [64, 4])
def test_long_words(spark, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    rnd, rows = random.Random(13), []
    for size in (63, 64, 65, 66, 90):
        word = "".join(rnd.choice("abcé") for _ in range(size))
        at = [0, size - 1, size // 2]
        some = [word, *[word[:k] + "x" + word[k:] for k in at], *[word[:k] + word[k + 1 :] for k in at], *[word[:k] + "y" + word[k + 1 :] for k in at], word[:3] + "zz" + word[3:], word[::-1]]
        rows += [(size, " ".join(some)), (size + 1000, " ".join(some))]
    assert table_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_runs_of_long_texts_are_whole(monkeypatch):
    text = "Wort ÉCLAIR über×ganz " * 50 + "x" * 100
    whole = list(spelling.runs(text))
    monkeypatch.setattr(spelling, "BLOCK", 3)
    assert list(spelling.runs(text)) == whole and whole[:3] == ["wort", "Éclair", "über×ganz"]


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError, match="code points"):
        spelling.near_pairs(spark.createDataFrame([("abc", 2)], "word string, n long"), 3)
