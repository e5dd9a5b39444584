import random
import re
import zlib

import numpy as np
import pytest
from edges import clashing_docs, edge_docs, edge_rows, empty_docs, small

import corpus_pipeline
from conftest import DATA
from telemill.llm import licenses, quality
from telemill.llm.workspace import table


def labels_of(spark, sf):
    return spark.read.parquet(f"{DATA}/{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    from telemill.llm.queries import op8_quality_trees

    scored = {r.doc_id: r for r in op8_quality_trees(spark, f"{DATA}/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in labels_of(spark, "sf0.1").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in scored.items())
    out = [(labels[k], r.predicted) for k, r in scored.items() if r.held_out and k in labels]
    assert len(out) > 500 and np.mean([a == b for a, b in out]) > 0.97


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = small(spark, DATA), labels_of(spark, "sf0.001")
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - quality, quality) as quality")
    a = sorted(tuple(r) for r in quality.classify(docs, labels).collect())
    b = sorted(tuple(r) for r in quality.classify(docs, turned).collect())
    assert a == b


def test_trees_split_what_can_be_split():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    one = quality.fit(x, np.ones(600))
    assert (one.score(x) == one.score(x)[0]).all() and one.score(x)[0] > 0.9
    assert (quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x) == 0.5).all()


def test_flat_traversal_equals_walking(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), (rng.random(300) > 0.5).astype(float)
    m = quality.fit(x, y)
    for row, score in zip(x[:20], m.score(x[:20]), strict=True):
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t in edge_rows()]
    together = quality.features(texts)
    assert np.array_equal(together, np.concatenate([quality.features([t]) for t in texts]))
    assert (together[[3, 4]] == 0).all() and np.isfinite(together).all()


def test_quality_of_edge_cases(spark):
    labels = labels_of(spark, "sf0.001")
    odd = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int"))
    out = quality.classify(clashing_docs(spark), odd).collect()
    assert len(out) == len(edge_rows()) and len({r.score for r in out if r.doc_id in (1, 2)}) == 1 and all(not r.held_out for r in out if r.doc_id is None)
    assert quality.classify(empty_docs(spark), labels).count() == 0
    assert quality.classify(edge_docs(spark), labels.where("false")).select("score").distinct().count() == 1
    kept = quality.accepted(clashing_docs(spark), odd)
    assert kept.columns == clashing_docs(spark).columns
    assert kept.count() == sum(r.predicted for r in out)


# Licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lowered(text))
    places = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_base_columns_equal_brute_force(spark):
    extra = ["mit license", "MIT-License mit,license", "xmit license mit licenses émit license", "the GNU General Public\nLicense apache  license apache.license", "license mit"]
    rows = edge_rows() + [(100 + k, t) for k, t in enumerate(extra)] + [(1000 + r.doc_id, r.text) for r in small(spark, DATA).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan(df).collect())
    want = []
    for k, t in rows:
        n, places = brute_base(t)
        at = [i for _, i in places]
        want.append(str((k, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places})))))
    assert got == sorted(want)


def altered(rng, text, k):
    x = list(text)
    for _ in range(k):
        at = rng.randrange(1, len(x) - 1)
        kind = rng.random()
        if kind < 0.4:
            x[at] = rng.choice("qz7")
        elif kind < 0.7:
            x.insert(at, rng.choice("qz7"))
        else:
            del x[at]
    return "".join(x)


def test_every_notice_within_its_errors_is_found():
    rng = random.Random(3)
    fuzzy = licenses.FuzzyNotices()
    for notice, label in licenses.NOTICES.items():
        for _ in range(25):
            text = "vorher etwas text. " + altered(rng, notice, rng.randrange(0, licenses.errors_allowed(notice) + 1)) + " und danach."
            places = fuzzy.find(text)
            assert len(places) == 1, (notice, text)
            if label not in ("cc-by-nc-4.0-notice", "cc-by-sa-4.0-notice"):
                assert places[0].label == label
            assert places[0].edits <= licenses.errors_allowed(notice)


def test_seeds_lose_nothing_against_a_search_of_the_whole_text():
    import regex

    rng = random.Random(4)
    notice = "all rights reserved"
    fuzzy = licenses.FuzzyNotices({notice: "x"})
    whole = regex.compile(f"(?b)(?:{notice}){{e<=1}}")
    for _ in range(150):
        text = " ".join(rng.choice((altered(rng, notice, rng.randrange(0, 4)), "all", "rights reserved", "andere worte")) for _ in range(rng.randrange(1, 7)))
        assert bool(fuzzy.find(text)) == bool(whole.search(text))
    two = fuzzy.find("all rights reservd und all rights reserved")
    assert [(p.start, p.edits) for p in two] == [(0, 1), (23, 0)]


def test_possible_ends_equal_the_table_of_distances():
    rng = random.Random(5)
    for _ in range(300):
        notice = "".join(rng.choice("abc ") for _ in range(rng.randrange(3, 12)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        most, a = rng.randrange(0, 3), rng.randrange(0, 5)
        row = list(range(len(notice) + 1))
        want = []
        for j, c in enumerate(text[a:], a + 1):
            diagonal, row[0] = row[0], 0
            for i, x in enumerate(notice, 1):
                diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (x != c))
            if row[-1] <= most:
                want.append(j)
        runs = licenses.possible_ends(notice, text, a, len(text), most)
        assert [j for x, y in runs for j in range(x, y + 1)] == want and all(x[1] + 1 < y[0] for x, y in zip(runs[:-1], runs[1:], strict=True))


def test_stretches_full_of_seeds_end_soon():
    import time

    fuzzy, began = licenses.FuzzyNotices(), time.time()
    assert fuzzy.find("redistribution and use in source and " * 5000) == []
    assert len(fuzzy.find("all rights reserved. " * 5000)) == 5000
    assert time.time() - began < 30


def test_scan_of_edge_cases(spark):
    out = {r.doc_id: r for r in licenses.scan(clashing_docs(spark)).collect()}
    assert (out[3].n_words, out[3].labels, out[3].score) == (0, "", 0.0)
    assert out[1].labels == "all-rights-reserved" and out[1].score == 1.0 and out[1].spans[0].edits == 0
    assert licenses.scan(empty_docs(spark)).count() == 0


# Pipeline


def test_stages_follow_one_another(spark):
    folder = f"{DATA}/sf0.001"
    docs = table(spark, folder, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        assert docs.where("text is not null and n_chars != length(text)").count() == 0 or name == "quality_trees"
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    rows = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect())
    assert rows == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert {r[0] for r in rows} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("make", [edge_docs, empty_docs, clashing_docs])
def test_stages_take_edge_cases(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert set(docs.columns) - {"pii", "n_lines"} <= set(out.columns)
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001").count() >= docs.count()


def test_clean_documents_pass_the_quality_stage(spark):
    folder = f"{DATA}/sf0.1"
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, table(spark, folder, "documents"), folder).select("doc_id").collect()}
    good = [r.doc_id for r in labels_of(spark, "sf0.1").where("quality = 1").collect()]
    assert np.mean([k in kept for k in good]) > 0.99
