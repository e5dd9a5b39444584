"""Document quality: gradient-boosted trees over histograms of document statistics.

Statistics are counted for many texts at once in numpy.  The trees are grown level by level from gradient histograms
over quantile bins, on the driver, from a sample of labelled rows whose size is bounded (SAMPLE); all trees together
are three flat arrays, which rows traverse in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns, map_slices
from .shingles import word_bounds, word_hashes

#: At most so many labelled rows are fetched to fit the model; chosen by a hash of the id.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, PENALTY = 64, 80, 4, 0.15, 10, 1.0
ACCEPT = 0.7

#: Classes of bytes that are counted.
_LETTER, _CAPITAL, _DIGIT, _BLANK, _BREAK, _STOP, _BANG, _BAR, _SIGN, _QUOTE, _BRACKET, _HIGH, _CONTROL, _OTHER = range(14)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[:32], _CLASS[127] = _CONTROL, _CONTROL
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LETTER, _CAPITAL, _DIGIT, _HIGH
for _chars, _kind in ((" \t", _BLANK), ("\n\r\v\f", _BREAK), (".,;:?", _STOP), ("!", _BANG), ("|", _BAR), ("*&$%#@~^", _SIGN), ("'\"`", _QUOTE), ("()[]{}<>", _BRACKET)):
    _CLASS[list(_chars.encode())] = _kind
_INSIDE = ~np.isin(_CLASS, (_BLANK, _BREAK))
_CASE = np.arange(256, dtype=np.uint8)
_CASE[65:91] += 32

FEATURES = (
    "log_bytes", "letters", "capitals", "digits", "blanks", "breaks", "stops", "bangs", "bars", "signs", "quotes", "brackets", "high", "control", "other",
    "log_words", "mean_word", "longest_word", "short_words", "repeats", "distinct_words", "signed_words", "mean_line", "stopped_lines",
)


def features(texts: list[str | None]) -> np.ndarray:
    """(n, len(FEATURES)) statistics; a null text counts as an empty one, which has zeros."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    n, kinds = len(raw), 14
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    cls = _CLASS[buf]
    counts = np.bincount(doc * np.int32(kinds) + cls, minlength=n * kinds).reshape(n, kinds).astype(float)
    counts[:, _BREAK] -= 1
    size = sizes - 1
    share = counts / np.maximum(size, 1)[:, None]

    starts, ends = word_bounds(_INSIDE[buf])
    owner = doc[starts]
    length = (ends - starts).astype(float)
    words = np.bincount(owner, minlength=n)
    per_word = lambda w: np.bincount(owner, weights=w, minlength=n) / np.maximum(words, 1)
    hashes = word_hashes(_CASE[buf], starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order))
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], weights=new, minlength=n) / np.maximum(words, 1)
    tail = cls[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    signed = np.isin(tail, (_SIGN, _BANG, _BAR))

    breaks = np.flatnonzero(cls == _BREAK)
    line_owner = doc[breaks]
    lines = np.bincount(line_owner, minlength=n)
    before = cls[np.maximum(breaks - 1, 0)]
    stopped = np.bincount(line_owner, weights=(before == _STOP).astype(float), minlength=n) / np.maximum(lines, 1)
    columns = [np.log1p(size), *share.T, np.log1p(words), per_word(length), np.log1p(longest), per_word(length <= 2), per_word(same), distinct, per_word(signed), np.log1p(size / np.maximum(lines, 1)), stopped]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Forest:
    """TREES complete binary trees of DEPTH levels: node k has children 2k+1 and 2k+2; leaves have values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic boosting; without rows of both labels every score is the share of label 1 (one half without rows)."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    inner = 2**DEPTH - 1
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = BINS + 1
    offset = np.arange(x.shape[1]) * width
    f_all, t_all, v_all = (np.zeros((TREES, k)) for k in (inner, inner, inner + 1))
    total = np.full(n, empty.base)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, here = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (x.shape[1] * width) + offset + binned).ravel()
            g, h, m = (np.bincount(cell, weights=w, minlength=here * x.shape[1] * width).reshape(here, x.shape[1], width).cumsum(axis=2) for w in (np.repeat(grad, x.shape[1]), np.repeat(hess, x.shape[1]), np.ones(len(cell))))
            gt, ht, mt = g[:, :, -1:], h[:, :, -1:], m[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (gt - g) ** 2 / (ht - h + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(m < LEAST_ROWS) | (mt - m < LEAST_ROWS)] = -1
            best = gain.reshape(here, -1).argmax(axis=1)
            feature, cut = best // width, best % width
            split = gain.reshape(here, -1).max(axis=1) > 1e-9
            for k in range(here):
                e = edges[feature[k]]
                f_all[tree, first + k] = feature[k] if split[k] else 0
                t_all[tree, first + k] = e[cut[k]] if split[k] and cut[k] < len(e) else np.inf
            at = node
            node = 2 * at + 1 + (x[np.arange(n), f_all[tree, at].astype(int)] > t_all[tree, at])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (grad, hess))
        v_all[tree] = -RATE * g / (h + PENALTY)
        total += v_all[tree, leaf]
    return Forest(f_all.astype(np.int64), t_all, v_all, empty.base)


def held_out():
    """Rows from which labels are never learnt."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A model from at most ``sample`` labelled ids that aren't held out (rows with a null id or label don't count).

    An id with several labels counts as good when half of them or more are 1.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "quality": cols["quality"], "x": list(features(cols["text"]))}

    # ``sample`` rows of two numbers at most, so broadcasting is safe.
    rows = map_columns(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), run, "doc_id long, quality int, x array<double>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in got], dtype=float))


def _scored(texts: list, model: Forest) -> np.ndarray:
    return model.score(features(texts)) if texts else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= accept) of each row of ``docs``.

    Nothing but the text enters a score.  A null text scores as an empty one; a null id is not held out; repeated rows
    get equal scores; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    model = train(docs, labels, sample)

    def run(cols: dict) -> dict:
        s = _scored(cols["text"], model)
        return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= accept).astype(np.int32)}

    out = map_columns(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` predicts as 1."""
    model = train(docs, labels, sample)

    at = docs.columns.index("text")

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(_scored(part.column(at).to_pylist(), model) >= accept))

    return map_slices(docs, keep, docs.schema)
