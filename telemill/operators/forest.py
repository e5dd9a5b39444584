"""Random forests whose trees grow until their leaves are small, without a model that grows with the rows.

The upper part of each tree is grown from histograms that executors add up, for several trees at once, until a node
holds few enough rows for one task.  Then the rows that train a tree and those that are to be predicted meet by tree and
node; each task grows what is below its node and predicts at once, so the lower parts of trees, which together have as
many leaves as there are rows, never leave their tasks.  A row's prediction is the mean over trees.

A tree sees nothing of a row but its bins, so rows of equal bins are one cell: how often they are drawn and their targets'
sum, in whole steps, are told for each tree by the task that reads them, and rows to be predicted are told apart by their
bins.  Where hardly any rows are equal they are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from telemill.sources.scratch import written

from . import boosting
from .quantiles import column_quantiles
from .trees import Tree, bin_edges, binned

SLOTS = boosting.SLOTS
#: Rows of which a task makes cells at once, cells that it holds, and rows of a cell on average from which cells are made.
CHUNK, MOST_CELLS, EQUAL = 1 << 18, 1 << 17, 2


@dataclass(frozen=True)
class Settings:
    trees: int = 500
    least: int = 5
    local: int = 1 << 16
    at_once: int = 16
    bins: int = 255
    seed: int = 42


def drawn(mark: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: by Poisson's law of mean 1, as drawing with replacement gives."""
    u = boosting.chance(mark, seed * 100_003 + tree)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, u, side="right")


_CELLS = "n int, bins binary, y binary, now binary, mark binary, w binary, steps binary"


def grouped(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal columns of ``bins`` (8 rows or fewer) stand together, and where each kind begins in it."""
    key = np.zeros((bins.shape[1], 8), np.uint8)
    key[:, : len(bins)] = bins.T
    key = key.view(np.uint64)[:, 0]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    return order, first


def merged(bins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``bins`` and the sums of each one's columns of whole numbers."""
    order, first = grouped(bins)
    return bins[:, order[first]], np.array([np.add.reduceat(row[order], first) for row in sums])


def cells(blocks: DataFrame, features: int, numbers: list[int], seed: int, scale: float) -> DataFrame:
    """Blocks of cells, with the draws and targets' whole steps of each of some trees; blocks as they are if few are equal."""
    schema = to_arrow_schema(_parse_datatype_string(_CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: tuple[np.ndarray, np.ndarray] | None = None

        def rows_of(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*values, strict=True), schema, strict=True)], schema=schema)

        def told() -> Iterator[pa.RecordBatch]:
            bins, sums = found
            for at in range(0, bins.shape[1], boosting.BLOCK):
                some = slice(at, at + boosting.BLOCK)
                part = np.ascontiguousarray(sums[:, some])
                half = len(numbers)
                yield rows_of([(part.shape[1], np.ascontiguousarray(bins[:, some]).tobytes(), None, None, None, part[:half].tobytes(), part[half:].tobytes())])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found
            bins = np.concatenate([h[0] for h in held], axis=1)
            y, now, mark = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            if features <= 8 and bins.shape[1]:
                order, first = grouped(bins)
                if EQUAL * len(first) <= len(order):
                    steps, sums = np.rint((now - y) * scale).astype(np.int64), np.empty((2 * len(numbers), len(first)), np.int64)
                    for k, t in enumerate(numbers):  # one tree at a time, so that no table of rows by trees is held
                        w = drawn(mark, t, seed)
                        sums[k], sums[len(numbers) + k] = np.add.reduceat(w[order], first), np.add.reduceat((w * steps)[order], first)
                    more = bins[:, order[first]], sums
                    found = more if found is None else merged(np.concatenate((found[0], more[0]), axis=1), np.concatenate((found[1], more[1]), axis=1))
                    if found[0].shape[1] > MOST_CELLS:
                        yield from told()
                        found = None
                    held.clear()
                    return
            for b, y, now, mark in held:
                yield rows_of([(len(y), np.ascontiguousarray(b).tobytes(), y.tobytes(), now.tobytes(), mark.tobytes(), None, None)])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(boosting._opened(batch, k, features))
                if sum(len(h[1]) for h in held) >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()
        if found is not None:
            yield from told()

    return blocks.mapInArrow(run, _CELLS)


def _opened(batch: pa.RecordBatch, k: int, features: int, numbers: list[int], seed: int, scale: float):
    """A block's bins, and a function that tells each one's draws for a tree and the whole steps of what is drawn."""
    if not batch["w"][k].is_valid:
        bins, y, now, mark = boosting._opened(batch, k, features)
        steps = np.rint((now - y) * scale).astype(np.int64)

        def told(t: int) -> tuple[np.ndarray, np.ndarray]:
            w = drawn(mark, t, seed)
            return w, w * steps

        return bins, told
    n = batch["n"][k].as_py()
    bins, w, steps = (np.frombuffer(batch[c][k].as_buffer(), kind).reshape(-1, n) for c, kind in (("bins", np.uint8), ("w", np.int64), ("steps", np.int64)))
    place = {t: i for i, t in enumerate(numbers)}
    return bins, lambda t: (w[place[t]], steps[place[t]])


def best_splits(node: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray, nodes: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the (feature, bin, gain) that lessens squared error most; feature -1 where nothing does.

    A side has ``least`` drawn rows or more; of equal gains the first feature, then the lowest bin.
    """
    total, sums = np.bincount(node, w, nodes), np.bincount(node, wy, nodes)
    feature, cut, best = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    for f in range(len(bins)):
        key = node * SLOTS + bins[f]
        order = np.argsort(key, kind="stable")
        k, of = key[order], node[order]
        left, left_sum = np.cumsum(w[order]), np.cumsum(wy[order])
        first = np.searchsorted(of, np.arange(nodes))
        left = left - np.concatenate(([0.0], left))[first][of]
        left_sum = left_sum - np.concatenate(([0.0], left_sum))[first][of]
        ends = np.flatnonzero(np.append((k[1:] != k[:-1]) & (of[1:] == of[:-1]), False))
        a, s, n = left[ends], left_sum[ends], of[ends]
        b = total[n] - a
        ok = (a >= least) & (b >= least)
        ends, a, b, s, n = ends[ok], a[ok], b[ok], s[ok], n[ok]
        gain = s * s / a + (sums[n] - s) ** 2 / b - sums[n] ** 2 / total[n]
        top = np.lexsort((-ends, gain, n))  # the last of each node is its best, the lowest bin of equal ones
        last = np.flatnonzero(np.append(n[top][1:] != n[top][:-1], True)) if len(top) else top
        pick = top[last]
        better = gain[pick] > best[n[pick]] + 1e-12
        pick = pick[better]
        feature[n[pick]], cut[n[pick]], best[n[pick]] = f, bins[f][order[ends[pick]]], gain[pick]
    return feature, cut, best


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, ask: np.ndarray, least: int) -> np.ndarray:
    """Predictions for the columns of ``ask`` by a tree of the drawn rows, level by level until nothing can be split."""
    out = np.zeros(ask.shape[1])
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    asked, at = np.arange(ask.shape[1]), np.zeros(ask.shape[1], np.int64)
    nodes, w = 1, w.astype(np.float64)
    wy = w * y
    while True:
        value = np.bincount(node, wy[rows], nodes) / np.bincount(node, w[rows], nodes)
        feature, cut, _ = best_splits(node, bins[:, rows], w[rows], wy[rows], nodes, least)
        leaf = feature < 0
        out[asked[leaf[at]]] = value[at[leaf[at]]]
        if leaf.all():
            return out
        child = 2 * (np.cumsum(~leaf) - 1)

        def down(which: np.ndarray, where: np.ndarray, table: np.ndarray, leaf=leaf, child=child, feature=feature, cut=cut) -> tuple[np.ndarray, np.ndarray]:
            which, where = which[~leaf[where]], where[~leaf[where]]
            return which, child[where] + (table[feature[where], which] > cut[where])

        rows, node = down(rows, node, bins)
        asked, at = down(asked, at, ask)
        nodes = 2 * int((~leaf).sum())


def _upper(blocks: DataFrame, features: int, numbers: list[int], s: Settings, scale: float) -> list[Tree]:
    """The upper parts of some trees: nodes of more than ``local`` drawn rows are split."""
    limits = boosting.Settings(least=s.least)
    nodes = {t: {0: boosting._Node(0, 0, 0)} for t in numbers}
    ask = [(t, 0) for t in numbers]
    while ask:
        trees = {t: boosting.as_tree(nodes[t], [k for k, x in nodes[t].items() if x.children], lambda _: 0.0) for t in numbers}
        slots: dict[int, np.ndarray] = {}
        for i, (t, k) in enumerate(ask):
            slots.setdefault(t, np.full(len(trees[t].left), -1, np.int64))[_places(nodes[t])[k]] = i
        found = boosting._best(_sums(blocks, features, trees, slots, len(ask), s, scale), limits, scale).collect()
        got = boosting.picked(found, list(range(len(ask))))
        after = []
        for i, (t, k) in enumerate(ask):
            if i not in got:
                continue
            x = nodes[t][k]
            x.n, x.g, x.split = got[i]
            if x.n > s.local and x.split:
                x.children = (len(nodes[t]), len(nodes[t]) + 1)
                nodes[t][x.children[0]] = boosting._Node(x.split.n, x.split.g, x.depth + 1)
                nodes[t][x.children[1]] = boosting._Node(x.n - x.split.n, x.g - x.split.g, x.depth + 1)
                after += [(t, c) for c in x.children if nodes[t][c].n > s.local]
        ask = after
    return [boosting.as_tree(nodes[t], [k for k, x in nodes[t].items() if x.children], lambda _: 0.0) for t in numbers]


def _places(nodes: dict[int, boosting._Node]) -> dict[int, int]:
    order = [0]
    for k in order:
        order += nodes[k].children or ()
    return {k: i for i, k in enumerate(order)}


def _sums(blocks: DataFrame, features: int, trees: dict[int, Tree], slots: dict[int, np.ndarray], count: int, s: Settings, scale: float) -> DataFrame:
    """(slot, feature, sums): drawn rows and their targets' whole steps by bin, of nodes of several trees."""
    schema = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By place alone, so that a block's work doesn't grow with the number of nodes.
        total = np.zeros((features, 2, count * SLOTS), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                bins, told = _opened(batch, k, features, list(trees), s.seed, scale)
                for t, slot in slots.items():
                    at, (w, steps) = slot[trees[t].ends(bins)], told(t)
                    rows = np.flatnonzero((at >= 0) & (w > 0))
                    place, some, more = at[rows] * SLOTS, w[rows], steps[rows]
                    for f in range(features):
                        where = place + bins[f, rows]
                        np.add.at(total[f, 0], where, some)
                        np.add.at(total[f, 1], where, more)
        total = total.reshape(features, 2, count, SLOTS)
        rows = [(i, f, total[f, :, i].tobytes()) for i in range(count) for f in range(features) if total[f, 0, i].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, "slot int, feature int, sums binary")


_PIECES = "tree int, node int, kind int, n int, bins binary, w binary, steps binary"


def _by_node(at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node and those of ``rows`` that end there."""
    if not len(rows):
        return
    rows = rows[np.argsort(at[rows], kind="stable")]
    first = np.flatnonzero(np.append(True, at[rows][1:] != at[rows][:-1])).tolist()
    for a, b in zip(first, [*first[1:], len(rows)], strict=True):
        yield int(at[rows[a]]), rows[a:b]


def _pieces(cells: DataFrame, features: int, trees: dict[int, Tree], s: Settings, scale: float) -> DataFrame:
    """The drawn rows or cells of each block by tree and node (kind 0)."""
    schema = to_arrow_schema(_parse_datatype_string(_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bins, told = _opened(batch, k, features, list(trees), s.seed, scale)
                for t, tree in trees.items():
                    w, steps = told(t)
                    out = [(t, node, 0, len(rows), np.ascontiguousarray(bins[:, rows]).tobytes(), w[rows].astype(np.int64).tobytes(), steps[rows].tobytes()) for node, rows in _by_node(tree.ends(bins), np.flatnonzero(w > 0))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return cells.mapInArrow(run, _PIECES)


def _asked(kinds: DataFrame, features: int, trees: dict[int, Tree]) -> DataFrame:
    """The distinct bins of rows to be predicted by tree and node (kind 1)."""
    schema = to_arrow_schema(_parse_datatype_string(_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = np.ascontiguousarray(np.frombuffer(b"".join(batch["__bins"].to_pylist()), np.uint8).reshape(n, features).T)
            for t, tree in trees.items():
                out = [(t, node, 1, len(rows), np.ascontiguousarray(bins[:, rows]).tobytes(), None, None) for node, rows in _by_node(tree.ends(bins), np.arange(n))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return kinds.mapInArrow(run, _PIECES)


def _lower(pieces: DataFrame, features: int, least: int, base: float, scale: float) -> DataFrame:
    """(__bins, p): what each tree's lower part says of bins that are to be predicted; ``base`` if it has drawn no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            joined = lambda c: np.frombuffer(b"".join(r[c] for r in held if r["kind"] == 0), np.int64)
            table = lambda kind: np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(features, r["n"]) for r in held if r["kind"] == kind] or [np.zeros((features, 0), np.uint8)], axis=1)
            ask = table(1)
            if ask.shape[1]:
                bins, sums = table(0), np.array([joined("w"), joined("steps")])
                if features <= 8 and bins.shape[1]:
                    bins, sums = merged(bins, sums)
                w, steps = sums
                p = grown(bins, base - steps / (scale * w), w, ask, least) if len(w) else np.full(ask.shape[1], base)
                raw = ask.T.tobytes()
                names = [raw[k * features : (k + 1) * features] for k in range(ask.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(p)], names=["__bins", "p"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["tree"], held[0]["node"]) != (r["tree"], r["node"]):
                    yield from flush()
                held.append(r)
        if held:
            yield from flush()

    return pieces.repartition("tree", "node").sortWithinPartitions("tree", "node", "kind").mapInArrow(run, "__bins binary, p double")


def _with_bins(df: DataFrame, x: list[Column], edges: list[np.ndarray]) -> DataFrame:
    @F.pandas_udf("binary")
    def told(*columns: pd.Series) -> pd.Series:
        bins = binned([c.to_numpy(dtype=np.float64) for c in columns], edges)
        raw = bins.T.tobytes()
        return pd.Series([raw[k : k + len(bins)] for k in range(0, len(raw), len(bins))], dtype=object)

    return df.withColumn("__bins", told(*x) if x else F.lit(b""))


def predict(train: DataFrame, test: DataFrame, features: list[str], target: str, key: list[str], name: str = "prediction", settings: Settings | None = None) -> DataFrame:
    """``test`` with the prediction of a forest of the rows of ``train`` that have a target; ``key`` tells these apart.

    Missing features become the training rows' exact medians.  Without training rows predictions are null.
    """
    s = settings or Settings()
    medians = [q[0] or 0.0 for q in column_quantiles(train, features, [0.5])]
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)).alias(f"x{k}") for k, (c, m) in enumerate(zip(features, medians, strict=True))]
    names = [f"x{k}" for k in range(len(features))]
    ready = train.select(*x, F.nanvl(F.col(target).cast("double"), F.lit(None)).alias("y"), F.xxhash64(*key).alias("mark"))
    told = ready.agg(F.avg("y").alias("m"), F.min("y").alias("a"), F.max("y").alias("b")).first()
    if told.m is None:
        return test.withColumn(name, F.lit(None).cast("double"))
    base = float(f"{told.m:.9g}")
    scale = boosting.STEPS / (max(told.b - base, base - told.a) or 1.0)
    edges = bin_edges(ready.where("y is not null"), names, s.bins)
    blocks = written(boosting.pack(ready, names, "y", ["mark"], edges, base), "forest-train")
    numbered = written(_with_bins(test, x, edges), "forest-test")
    kinds = written(numbered.select("__bins").distinct(), "forest-ask")
    sums = None
    for start in range(0, s.trees, s.at_once):
        numbers = list(range(start, min(s.trees, start + s.at_once)))
        drawn_cells = written(cells(blocks, len(features), numbers, s.seed, scale), "forest-cells")
        upper = dict(zip(numbers, _upper(drawn_cells, len(features), numbers, s, scale), strict=True))
        both = _pieces(drawn_cells, len(features), upper, s, scale).unionByName(_asked(kinds, len(features), upper))
        got = _lower(both, len(features), s.least, base, scale).groupBy("__bins").agg(F.sum("p").alias("p"))
        sums = written(got if sums is None else sums.unionByName(got).groupBy("__bins").agg(F.sum("p").alias("p")), "forest-sums")
    p = sums.select(F.col("__bins").alias("__p_bins"), (F.col("p") / s.trees).alias("__p"))
    out = numbered.join(p, F.col("__bins") == F.col("__p_bins"), "left")
    return out.select(*[numbered[c] for c in test.columns], F.col("__p").alias(name))
