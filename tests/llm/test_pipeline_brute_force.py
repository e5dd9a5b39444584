"""The whole pipeline against plain Python over the smallest tables."""

import zlib

import numpy as np
from test_near_duplicates import Union, brute_components
from test_shards_packing_pieces import check_packing

import corpus_pipeline
from conftest import DATA
from telemill.llm import linededup, pii, quality
from telemill.llm.queries import PII_KEY
from telemill.llm.workspace import table

FOLDER = f"{DATA}/sf0.001"


def walk(model, row):
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        k = 0
        while k < len(f):
            k = 2 * k + 1 + int(row[f[k]] > t[k])
        total += v[k - len(f)]
    return 1 / (1 + np.exp(-total))


def without_repeats(texts, edits=2, least=20):
    lines = [(k, i, x.strip(" \t\r\x0b\x0c").encode()) for k in sorted(texts) for i, x in enumerate(texts[k].split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = sorted({x[2] for x in lines})
    sizes = np.array([len(x) for x in distinct])
    letters = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in distinct])
    u = Union(range(len(distinct)))
    for i, a in enumerate(distinct):
        # An edit changes the counts of two letters at most; the table decides on what is left.
        near = np.flatnonzero((sizes[i] >= least) & (sizes[:i] >= least) & (np.abs(sizes[:i] - sizes[i]) <= edits) & (np.abs(letters[:i] - letters[i]).sum(axis=1) <= 2 * edits))
        for j in near:
            if linededup._small(a, distinct[j]) <= edits:
                u.join(i, int(j))
    number = {x: u.find(i) for i, x in enumerate(distinct)}
    first, drop = {}, set()
    for k, i, x in lines:
        if first.setdefault(number[x], (k, i)) != (k, i):
            drop.add((k, i))
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in drop) for k, t in texts.items()}


def test_pipeline_equals_plain_python(spark):
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    learnt = sorted(k for k in labels if k in texts and zlib.crc32(str(k).encode()) % 4 != 2)
    model = quality.fit(quality.features([texts[k] for k in learnt]), np.array([labels[k] for k in learnt], dtype=float))
    texts = {k: t for k, t in texts.items() if walk(model, quality.features([t])[0]) >= 0.7}
    texts = without_repeats(texts)
    _, component = brute_components(texts)
    texts = {k: t for k, t in texts.items() if component[k] == k}
    p = pii.Pseudonyms(PII_KEY)
    texts = {k: pii.replace(t, p)[0] for k, t in texts.items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_packing(rows, texts, 2048)
