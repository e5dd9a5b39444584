import random
import time
import re
from collections import Counter

import numpy as np
import pytest
from edges import clashing_docs, edge_docs, edge_rows, empty_docs, small

from conftest import DATA
from telemill.llm import linededup, minhash, shingles, vectors


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# MinHash


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(texts):
    sets = {k: word_sets(t) for k, t in texts.items()}
    u = Union(sets)
    keys = sorted(sets)
    holders = {}
    for k in keys:
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    shared = Counter((a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return {k: len(s) for k, s in sets.items()}, {k: u.find(k) for k in keys}


def test_shingle_sets_equal_plain_sets():
    texts = [t for _, t in edge_rows()] + ["a b c d e", "A b c d E f", "a\x0bb\x0cc", "é É", "one two three four five six " * 9]
    got = list(shingles.shingle_sets(texts))
    assert [len(s) for s in got] == [len(word_sets(t)) for t in texts]
    by_set = {}
    for t, s in zip(texts, got, strict=True):
        assert by_set.setdefault(frozenset(word_sets(t)), s.tobytes()) == s.tobytes()


def test_signatures_within_the_limit_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        where = rng.choice(minhash.SYMBOLS, minhash.LIMIT, replace=False)
        b[where] += 1
        keys = minhash.keys_of(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def mutated(rng, words, share):
    return " ".join(rng.choice(("neu", "alt", "klein")) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def family_docs():
    rng = random.Random(6)
    texts = {}
    for family in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 40, 200)))]
        for _ in range(12):
            texts[rng.randrange(10**6)] = mutated(rng, base, rng.choice((0, 0.005, 0.02, 0.04, 0.08)))
    for _ in range(40):
        texts[rng.randrange(10**6)] = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60)))
    return texts


@pytest.mark.parametrize(("block", "pivots"), [(1024, 16), (5, 16), (6, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    texts = family_docs() | {r.doc_id: r.text for r in small(spark, DATA).collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, expected = brute_components(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {k: r.n_shingles for k, r in got.items()} == sizes
    assert {k: r.component_id for k, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_dense_and_single_confirmation_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(400) > 0.05], rng.integers(0, 1 << 62, 15).astype(np.uint64)))) for _ in range(60)]
    sig = np.stack([minhash.signature(s) for s in sets])
    shared = sum(minhash._shared_counts(sets[:30], sets[30:]))
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[30 + j])) for i in range(30) for j in range(30))
    columns = {"node": list(range(60)), "own": [0] * 60, "signature": [s.tobytes() for s in sig], "hashes": sets}
    u = Union(range(60))
    for a, b in minhash.links(columns, 0, 0, 75):
        u.join(a, b)
    want = Union(range(60))
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    assert [u.find(k) for k in range(60)] == [want.find(k) for k in range(60)]


def test_near_duplicates_of_edge_cases(spark):
    out = minhash.near_duplicates(clashing_docs(spark)).collect()
    assert len(out) == len(edge_rows())
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert {(1, 13, 1, True), (2, 13, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (None, 0, None, True)} <= got
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = minhash.representatives(clashing_docs(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k in (1, 3, 4, 5, 6, 7, None, None, 9, -5))
    repeated = edge_docs(spark).where("doc_id = 2")
    assert minhash.representatives(repeated).count() == 1


def test_rows_that_share_one_id_or_none(spark):
    """Ids tell nothing apart here: work must not grow with the square of the rows that share one."""
    texts = list(family_docs().values())[:60]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] + [(5, texts[0])] * 20
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {5}
    alone = minhash.near_duplicates(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    assert {(r.component_id, r.kept) for r in alone} == {(None, True)}


# Lines


def test_edit_distance_equals_the_table():
    rng = random.Random(8)
    for _ in range(4000):
        letters = rng.choice(("ab", "abcdefgh"))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.4 or k == len(b):
                b.insert(k, rng.choice(letters))
            elif rng.random() < 0.5:
                del b[k]
            else:
                b[k] = rng.choice(letters)
        b = "".join(b)
        for most in (1, 2, 3):
            assert linededup.within_edits(a.encode(), b.encode(), most) == min(linededup._small(a.encode(), b.encode()), most + 1)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_edits_share_a_key(edits):
    rng = random.Random(9)
    for _ in range(400):
        a = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(edits + 2, 40)))
        b = bytearray(a)
        for _ in range(edits):
            k = rng.randrange(len(b))
            kind = rng.random()
            if kind < 0.4:
                b[k] = rng.choice(b"abcd")
            elif kind < 0.7:
                b.insert(k, 97)
            else:
                del b[k]
        a, b = sorted((a, bytes(b)), key=len)
        buf = np.frombuffer(a + b"\n" + b + b"\n", np.uint8)
        starts, ends = np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)])
        index, probe = linededup.keys(shingles.Prefixes(buf), starts, ends, edits)
        assert set(index[0]) & set(probe[1])


def brute_lines(texts, edits, least):
    lines = [(k, i, x.strip(" \t\r\x0b\x0c").encode()) for k in sorted(texts) for i, x in enumerate((texts[k] or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    distinct = sorted({x[2] for x in lines})
    u = Union(range(len(distinct)))
    for i, a in enumerate(distinct):
        for j in range(i):
            if abs(len(a) - len(distinct[j])) <= edits and linededup._small(a, distinct[j]) <= edits:
                u.join(i, j)
    number = {x: u.find(i) for i, x in enumerate(distinct)}
    first = {}
    for k, i, x in lines:
        first.setdefault(number[x], (k, i))
    return {(k, i) for k, i, x in lines if first[number[x]] != (k, i)}


@pytest.mark.parametrize("block", [1024, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = random.Random(10)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 45))).strip() for _ in range(40)]
    texts = {}
    for k in range(60):
        out = []
        for _ in range(rng.randrange(0, 7)):
            x = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                at = rng.randrange(len(x) + 1)
                x.insert(at, rng.choice("xyzé")) if rng.random() < 0.5 or at == len(x) else x.pop(at)
            out.append(rng.choice(("", "  ")) + "".join(x) + rng.choice(("", "\r")))
        texts[rng.randrange(10**6)] = "\n".join(out)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    dropped = brute_lines(texts, 2, 20)
    assert dropped
    for r in linededup.without_repeats(df).collect():
        lines = texts[r.doc_id].split("\n")
        keep = [x for i, x in enumerate(lines) if (r.doc_id, i) not in dropped]
        assert (r.text, r.n_lines, r.n_repeats) == ("\n".join(keep), len(lines), len(lines) - len(keep))


def test_line_dedup_by_shuffles_gives_the_same(spark):
    docs = small(spark, DATA)
    once = sorted(tuple(r) for r in linededup.without_repeats(docs).select("doc_id", "text", "n_repeats").collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert once == sorted(tuple(r) for r in linededup.without_repeats(docs).select("doc_id", "text", "n_repeats").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize(("cell", "overfull"), [(1 << 20, 1 << 17), (60, 1 << 17), (1 << 20, 15), (60, 15)])
def test_line_dedup_below_hot_keys(spark, monkeypatch, cell, overfull):
    """Lines of which most share a segment, or two, are found by the rest of them, in whatever cells they meet.

    The key may be known as hot beforehand, or may only turn out to have too many rows.
    """
    monkeypatch.setattr(linededup, "HOT_ROWS", 20 if overfull > 15 else 1 << 30)
    monkeypatch.setattr(linededup, "CELL", cell)
    monkeypatch.setattr(linededup, "OVERFULL", overfull)
    rng = random.Random(12)
    texts, k = {}, 0
    for head, tail in (("all of these lines begin alike: ", ""), ("", " is what these lines end with"), ("a beginning that is common, ", ", and an end that is common")):
        pool = ["".join(rng.choice("abcdefghij") for _ in range(18)) for _ in range(60)]
        for _ in range(150):
            x = list(rng.choice(pool))
            for _ in range(rng.choice((0, 1, 2, 3))):
                at = rng.randrange(len(x))
                x[at : at + rng.choice((0, 1))] = rng.choice(("", "z", "y"))
            texts[k] = f"{head}{''.join(x)}{tail}"
            k += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = linededup._lines(df, 2, 20, 20)
    assert (len(linededup._hot(table)[1][0]) > 3) == (overfull > 15)
    dropped = brute_lines(texts, 2, 20)
    assert {r.doc_id for r in linededup.without_repeats(df).collect() if r.n_repeats} == {k for k, _ in dropped} and len(dropped) < len(texts) - 100


def test_overfull_keys_below_hot_keys_are_compared():
    """Only a key of whole lines may give way in a second pass, as that finds no others again."""
    rng = random.Random(3)
    lines = ["a common beginning, and a common middle: " + "".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(60)]
    buf, _, _, starts, ends = linededup._lines_of(["\n".join(lines)], 20)
    ids = linededup._identities(buf, starts, ends)
    plain, _ = linededup._pairs(buf, starts, ends, ids, 2)
    found, n = np.unique(plain, return_counts=True)
    hot = found[n > 50]
    keys, values = linededup._pairs(buf, starts, ends, ids, 2, (hot, np.ones(len(hot), np.int64)))
    below = np.setdiff1d(keys, plain)
    groups = linededup._groups(keys, values, 1024, 15)
    over = groups["g"][groups["side"] == 3].view(np.uint64)
    sizes = dict(zip(*np.unique(keys, return_counts=True), strict=True))
    assert len(hot) and max(sizes[k] for k in below) > 15
    assert not len(np.intersect1d(over, below))
    assert len(linededup._groups(plain, np.arange(len(plain), dtype=np.uint64) * np.uint64(2) + np.uint64(1), 1024, 15)["g"])


def templates(spark, n, seed=5):
    """Documents of ten paragraphs out of a pool: each has weak neighbours, whose number doesn't depend on n; some are near copies."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(3000)}" for _ in range(20)) for _ in range(n // 10)]
    texts = {k: " ".join(rng.choice(pool) for _ in range(10)) for k in range(n)}
    for k in range(0, n - 1, 50):
        texts[k + 1] = texts[k] + " one more word"
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts


def test_weak_neighbours_dont_make_large_families(spark, monkeypatch):
    """What one connected family would compare all with all is parted by the pairs that are near at all."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    docs, texts = templates(spark, 1500)
    seen = []
    plain = minhash._links_within
    monkeypatch.setattr(minhash, "_links_within", lambda members, percent: seen.append(members) or plain(members, percent))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    sets, wanted = brute_components(texts)
    assert got == wanted and len(set(wanted.values())) < len(texts)
    sizes = [r["count"] for r in seen[0].groupBy("family").count().collect()]
    assert max(sizes) < 300 and sum(x * x for x in sizes) < 1500 * 1500 / 20


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_groups_of_keys_connect_what_is_near(block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, size=(6, minhash.SYMBOLS)).astype(np.uint16)
    sig = np.repeat(base, 8, axis=0)
    for k in range(len(sig)):
        at = rng.permutation(minhash.SYMBOLS)[: rng.integers(0, 24)]
        sig[k, at] = rng.integers(0, 1 << 16, size=len(at))
    keys = shingles.mix(minhash.keys_of(sig).ravel().view(np.uint64))
    nodes = np.repeat(np.arange(len(sig), dtype=np.uint64), minhash.SYMBOLS)
    order = np.argsort(keys)
    out = minhash._key_groups(keys[order], nodes[order])
    u = Union(range(len(sig)))
    label = {k: k for k in range(len(sig))}
    raw = [x.astype("<u2").tobytes() for x in sig]
    for a, b in minhash._near_pivots({"node": list(label), "is_pivot": [k in (0, 9, 11) for k in label], "signature": raw}):
        assert (sig[a] != sig[b]).sum() <= minhash.LIMIT
        u.join(a, b)
        if b not in (0, 9, 11):
            label[b] = a
    for a, b in zip(out["centre"].tolist(), out["node"].tolist(), strict=True):
        if a >= 0:
            u.join(a, b)
    for g in set(out["g"][out["centre"] < 0].tolist()):
        members = sorted(set(out["node"][(out["g"] == g) & (out["centre"] < 0)].tolist()))
        for a, b in minhash._near_signatures({"node": members, "label": [label[m] for m in members], "signature": [sig[m].astype("<u2").tobytes() for m in members]}):
            u.join(a, b)
    for a in range(len(sig)):
        for b in range(a):
            if (sig[a] != sig[b]).sum() <= minhash.LIMIT:
                assert u.find(a) == u.find(b)


def test_lines_of_blanks_take_linear_time():
    blanks = " " * 1_000_000
    texts = [f"{blanks}x y{blanks}", " \t", "", None, *["ab cd"] * 5000, f"a\r\n {blanks}\n b"]
    began = time.perf_counter()
    buf, text, number, starts, ends = linededup.split_lines(texts)
    assert time.perf_counter() - began < 1
    raw = buf.tobytes()
    assert [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == [b"x y", b"", b"", b"", *[b"ab cd"] * 5000, b"a", b"", b"b"]
    assert text.tolist()[-3:] == [5004] * 3 and number.tolist()[-3:] == [0, 1, 2]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_texts_whose_polynomials_collide(spark):
    """Polynomial hashes modulo 2**64 are equal for a Thue-Morse word and its complement, whatever the base."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: word, 2: word[:-1] + "c", 3: other}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_repeats) for r in linededup.without_repeats(df).collect()}
    assert got == {1: (word, 0), 2: ("", 1), 3: (other, 0)}
    assert [(r.doc_id, r.component_id) for r in minhash.near_duplicates(df.where("doc_id != 2")).orderBy("doc_id").collect()] == [(1, 1), (3, 3)]


def test_line_dedup_of_edge_cases(spark):
    out = linededup.without_repeats(clashing_docs(spark))
    assert {"node", "key", "__id", "repeats"} <= set(out.columns) and out.count() == len(edge_rows())
    rows = out.collect()
    assert {r.text for r in rows if r.doc_id == 3} == {None} and {r.n_lines for r in rows if r.doc_id == 3} == {0}
    first = next(r for r in rows if r.doc_id == -5)
    assert first.n_repeats == 0 and all(r.n_repeats >= 1 for r in rows if r.doc_id in (1, 2))
    assert linededup.without_repeats(empty_docs(spark)).count() == 0


def test_equal_lines_of_any_length_are_repeats(spark, tmp_path):
    """Short lines repeat equal ones only; blank lines stay."""
    from telemill.llm.queries import op9_segment_line_dedup

    texts = {1: "And ornd.\n\nx\na line that is long enough", 2: " And ornd.\r\n\nAnd ornd,\nx", 3: "x\n \nx\na line that is long enougH\nAnd ornd,"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_repeats) for r in op9_segment_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (texts[1], 0), 2: ("\nAnd ornd,", 2), 3: (" ", 4)}


def test_line_dedup_of_rows_that_share_one_id_or_none(spark):
    """A line number applies only to the text in which it was found; equal lines of such rows are repeats too."""
    a, b, c = (f"line {x} that is long enough to be looked at" for x in ("aaaaaaaa", "bbbbbbbb", "cccccccc"))
    rows = [(3, a), (None, f"{a}\nfoo"), (None, f"{b}\nbar"), (5, c), (5, f"{c}\nnew"), (6, f"{b}\nonce"), (None, b), (None, b)]
    copies = [(8, "a row that comes more than once\nx", k) for k in range(3)] + [(None, "a text without any id at all", k) for k in range(3)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + copies, "doc_id long, text string, other int")
    out = linededup.without_repeats(df).collect()
    got = Counter((r.doc_id, r.text) for r in out if r.doc_id != 5)
    want = [(3, a), (None, "foo"), (None, "bar"), (6, f"{b}\nonce"), (None, ""), (None, "")]
    want += [(8, copies[0][1]), (8, "x"), (8, "x"), (None, copies[3][1]), (None, ""), (None, "")]
    assert got == Counter(want)
    assert sorted(r.n_repeats for r in out if r.doc_id == 5) == [0, 1] and sorted(r.other for r in out if r.doc_id == 8) == [0, 1, 2]


# Vectors


def cluster_vectors(rng, n=300, dims=24):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            out.append(out[rng.integers(len(out))] + rng.normal(size=dims) * rng.choice((0.0, 0.02, 0.05, 0.08)))
        else:
            x = rng.normal(size=dims)
            out.append(x / np.linalg.norm(x))
    return [x.tolist() for x in out]


def brute_vectors(rows, cosine):
    good = {k: np.array(v, dtype=float) for k, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in good.items()}
    u, n = Union([k for k, _ in rows]), Counter()
    keys = list(unit)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                u.join(a, b)
                n[a] += 1
                n[b] += 1
    return {k: (n[k], u.find(k), u.find(k) == k) for k, _ in rows}


def test_vectors_equal_brute_force(spark):
    rows = list(enumerate(cluster_vectors(np.random.default_rng(5))))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] + [1.0] * 23), (1005, [float("inf")] + [1.0] * 23), (1006, [1.0, 0.0]), (1007, [2.0, 0.0]), (1008, rows[0][1]), (1009, rows[0][1])]
    df = spark.createDataFrame([(k, v, "mine") for k, v in rows], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows, 0.95)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 100 and found >= 0.9 * there and all(got[k][0] <= want[k][0] for k in got)
    assert got == want
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    rows = list(enumerate(cluster_vectors(np.random.default_rng(6), 200)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_vectors(rows, 0.95)


def test_codes_never_lose_a_pair():
    rng = np.random.default_rng(7)
    x = np.array(cluster_vectors(rng, 400))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vectors.fit(x, 4)
    home, _ = index.nearest(x, 0.3)
    codes = index.encode(index.residuals(x, home))
    error = np.linalg.norm(index.residuals(x, home) - index.decode(codes), axis=1)
    back = index.centres[home] + index.decode(codes)
    for i, j in np.argwhere(x @ x.T >= 0.95):
        assert np.linalg.norm(x[i] - back[j]) <= np.sqrt(0.1) + error[j] + 1e-9


def test_probes_never_lose_a_pair():
    """Close vectors that vary in few directions, in all lists that they are dealt to."""
    rng = np.random.default_rng(11)
    for dims in (1, 2, 3):
        ends, base = rng.normal(size=(dims, 64)), rng.normal(size=64)
        x = base + rng.uniform(-2, 2, size=(800, dims)) @ ends
        x /= np.linalg.norm(x, axis=1)[:, None]
        radius = np.sqrt(2 * (1 - 0.95))
        home, probes = vectors.fit(x, 24).nearest(x, radius)
        reached = np.zeros((len(x), home.max() + 1), dtype=bool)
        for k, p in enumerate(probes):
            reached[k, p[p <= home.max()]] = True
        seen = reached[:, home]
        assert (seen | seen.T)[x @ x.T >= 0.95].all()


def test_recall_on_the_test_table(spark):
    from telemill.llm.queries import op3_product_quantisation

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    want = brute_vectors(rows, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op3_product_quantisation(spark, f"{DATA}/sf0.001").collect()}
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values()) and all(got[k][0] <= want[k][0] for k in want)


def test_vectors_without_ids_and_repeated_rows(spark):
    a, b, far = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, far), (4, a), (4, a), (9, b), (7, far), (8, None), (8, None)]
    df = spark.createDataFrame([(k, v, "mine", "mine") for k, v in rows], "vec_id long, embedding array<float>, unit string, least string")
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in vectors.near_duplicates(df).collect())
    want = [(None, 3, 4, False), (None, 1, 7, False), (4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (7, 1, 7, True), (8, 0, 8, True), (8, 0, 8, True)]
    assert got == sorted(map(str, want))
    lonely = spark.createDataFrame([(None, a)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.near_duplicates(lonely).collect()] == [(None, 0, None, True)]
    copies = spark.createDataFrame([(5, a), (3, a), (4, [1.0, 0.0]), (6, None)], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vectors.near_duplicates(copies).collect()) == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (6, 0, 6, True)]
