"""Leaf-wise histogram boosting over all rows, with missing values as they are.

Rows are binned once and packed in blocks of a few thousand.  For each level of a tree, tasks add up the gradients of
their blocks by node, feature and bin; what the tasks found is combined on executors, where the best split of each node
and feature is chosen too, so the driver gets a line for each of them.  Gradients are whole numbers of a small step:
their sums are exact, and the trees are the same however rows are dealt over tasks.

A tree grows best first: of all leaves the one that gains most is split, up to a number of leaves.  Which leaves these
are is known after each level as far as that level goes, and only nodes that can still be among them are looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from telemill.sources.scratch import written

from .trees import MISSING, Ensemble, Tree, bin_edges, binned

#: Rows of a block; trees after which the blocks' predictions are brought up to date; steps of the largest residual.
BLOCK, REFRESH, STEPS = 8192, 4, 1 << 26
SLOTS = MISSING + 1


@dataclass(frozen=True)
class Settings:
    trees: int = 800
    leaves: int = 64
    depth: int = 10
    rate: float = 0.05
    least: int = 20
    penalty: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class _Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    n: int
    g: int


@dataclass
class _Node:
    n: int
    g: int
    depth: int
    split: _Split | None = None
    children: tuple[int, int] | None = None


_BLOCKS = "n int, bins binary, y binary, now binary, mark binary"


def pack(df: DataFrame, features: list[str], target: str, key: list[str], edges: list[np.ndarray], base: float, mark: Column | None = None) -> DataFrame:
    """Blocks of the rows that have a target: bins by feature, target, prediction so far, and a number from the key.

    ``mark`` is that number, if it isn't to be a hash of the key.
    """
    rows = df.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(target).cast("double").alias("y"), (F.xxhash64(*key) if mark is None else mark).alias("mark"))
    schema = to_arrow_schema(_parse_datatype_string(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                columns = [part[f"x{k}"].to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(features))]
                y, mark = part["y"].to_numpy(), part["mark"].to_numpy()
                use = ~np.isnan(y)
                bins = binned(columns, edges)[:, use] if columns else np.zeros((0, int(use.sum())), np.uint8)
                row = [int(use.sum()), bins.tobytes(), y[use].tobytes(), np.full(use.sum(), base).tobytes(), mark[use].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, _BLOCKS)


def _opened(batch: pa.RecordBatch, k: int, features: int) -> tuple[np.ndarray, ...]:
    n = batch["n"][k].as_py()
    raw = lambda c: batch[c][k].as_buffer()
    return np.frombuffer(raw("bins"), np.uint8).reshape(features, n), np.frombuffer(raw("y")), np.frombuffer(raw("now")), np.frombuffer(raw("mark"), np.uint64)


def chance(mark: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's mark and a salt alone."""
    z = mark + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def _sums(blocks: DataFrame, features: int, used: list[int], pending: list[Tree], tree: Tree, slot: np.ndarray, scale: float, salt: int, share: float) -> DataFrame:
    """(slot, feature, sums): counts and gradients by bin of the rows that end in a node with a slot."""
    slots = int(slot.max()) + 1
    schema = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), slots, 2, SLOTS), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                bins, y, now, mark = _opened(batch, k, features)
                for t in pending:
                    now = now + t(bins)
                at = slot[tree.ends(bins)]
                rows = np.flatnonzero((at >= 0) & (chance(mark, salt) < share) if share < 1 else at >= 0)
                place, g = at[rows] * SLOTS, np.rint((now[rows] - y[rows]) * scale)
                for j, f in enumerate(used):
                    where = place + bins[f, rows]
                    total[j, :, 0] += np.bincount(where, minlength=slots * SLOTS).reshape(slots, SLOTS)
                    total[j, :, 1] += np.bincount(where, g, slots * SLOTS).reshape(slots, SLOTS).astype(np.int64)
        names = [(s, f, total[j, s].tobytes()) for j, f in enumerate(used) for s in range(slots) if total[j, s, 0].any()]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*names, strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, "slot int, feature int, sums binary")


def best_split(counts: np.ndarray, gradients: np.ndarray, s: Settings, scale: float) -> tuple[float, int, bool, int, int] | None:
    """(gain, bin, missing_left, rows and gradient on the left) of the best split of one node by one feature.

    Missing values are tried on either side; of equal gains the one with missing values right, then the lowest bin, is
    taken.  Gradients are in whole steps.
    """
    n, g = int(counts.sum()), int(gradients.sum())
    score = lambda a, b: (b / scale) ** 2 / (a + s.penalty)
    best = None
    for missing_left in (False, True):
        if missing_left and not counts[MISSING]:
            break
        a = np.cumsum(counts[:MISSING]) + (counts[MISSING] if missing_left else 0)
        b = np.cumsum(gradients[:MISSING]) + (gradients[MISSING] if missing_left else 0)
        use = np.flatnonzero((a >= max(s.least, 1)) & (n - a >= max(s.least, 1)))
        if len(use):
            gain = score(a[use], b[use].astype(np.float64)) + score(n - a[use], (g - b[use]).astype(np.float64)) - score(n, float(g))
            k = int(np.argmax(gain))
            if gain[k] > 1e-12 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), int(use[k]), missing_left, int(a[use[k]]), int(b[use[k]]))
    return best


def _best(sums: DataFrame, s: Settings, scale: float) -> DataFrame:
    """(slot, feature, n, g and the best split) of every node and feature, from what all tasks have summed."""
    schema_text = "slot int, feature int, n long, g long, gain double, bin int, missing_left boolean, n_left long, g_left long"
    schema = to_arrow_schema(_parse_datatype_string(schema_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, f, raw in zip(batch["slot"].to_pylist(), batch["feature"].to_pylist(), batch["sums"], strict=True):
                more = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, SLOTS)
                total[k, f] = total[k, f] + more if (k, f) in total else more
        rows = []
        for (k, f), (counts, gradients) in total.items():
            rows.append((k, f, int(counts.sum()), int(gradients.sum()), *(best_split(counts, gradients, s, scale) or (None,) * 5)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return sums.repartition("slot", "feature").mapInArrow(run, schema_text)


def chosen(nodes: dict[int, _Node], leaves: int) -> list[int]:
    """The nodes that a best-first growth to ``leaves`` leaves splits, of those known; of equal gains the older node."""
    heap = [(-nodes[0].split.gain, 0)] if 0 in nodes and nodes[0].split else []
    out: list[int] = []
    while heap and len(out) < leaves - 1:
        _, k = heapq.heappop(heap)
        out.append(k)
        for c in nodes[k].children or ():
            if nodes[c].split:
                heapq.heappush(heap, (-nodes[c].split.gain, c))
    return out


def as_tree(nodes: dict[int, _Node], splits: list[int], value) -> Tree:
    """The nodes that are left if only ``splits`` are split, as arrays."""
    split, order, rows = set(splits), [0], []
    for k in order:
        if k in split:
            order += nodes[k].children
    place = {k: i for i, k in enumerate(order)}
    for k in order:
        node = nodes[k]
        if k in split:
            s = node.split
            rows.append((s.feature, s.bin, s.missing_left, place[node.children[0]], place[node.children[1]], 0.0, node.n))
        else:
            rows.append((-1, 0, False, -1, -1, value(node), node.n))
    return Tree.of(rows)


def _grow(evaluate, s: Settings, value) -> Tree:
    """``evaluate(tree, {node: place in the tree})`` gives (n, g, split) of nodes; see the module's beginning."""
    nodes = {0: _Node(0, 0, 0)}
    ask = [0]
    while ask:
        tree = as_tree(nodes, [k for k, x in nodes.items() if x.children], lambda _: 0.0)
        order, inner = [0], {k for k, x in nodes.items() if x.children}
        for k in order:
            if k in inner:
                order += nodes[k].children
        places = {k: i for i, k in enumerate(order)}
        for k, (n, g, split) in evaluate(tree, {k: places[k] for k in ask}).items():
            nodes[k].n, nodes[k].g, nodes[k].split = n, g, split
        ask = []
        for k in sorted(chosen(nodes, s.leaves)):
            x = nodes[k]
            if x.children:
                continue
            left = _Node(x.split.n, x.split.g, x.depth + 1)
            right = _Node(x.n - x.split.n, x.g - x.split.g, x.depth + 1)
            x.children = (len(nodes), len(nodes) + 1)
            for c, node in zip(x.children, (left, right), strict=True):
                nodes[c] = node
                if node.depth < s.depth and node.n >= 2 * max(s.least, 1):
                    ask.append(c)
    return as_tree(nodes, chosen(nodes, s.leaves), value)


def columns_of(features: list[str], tree: int, s: Settings) -> list[int]:
    """The features that a tree may use: a share of them by hash, one at least."""
    marks = [zlib.crc32(f"{s.seed}:{tree}:{name}".encode()) / 2**32 for name in features]
    return [k for k, m in enumerate(marks) if m < s.columns] or [int(np.argmin(marks))]


def fit(df: DataFrame, features: list[str], target: str, key: list[str], settings: Settings | None = None) -> Ensemble:
    """A boosted ensemble for squared error of all rows that have a target; ``key`` names the columns that tell rows apart.

    Null and NaN features are missing, and go where a split gains most; nothing is imputed.  Without rows, or if the
    target is constant, there are no trees.
    """
    s = settings or Settings()
    edges = bin_edges(df.where(F.col(target).isNotNull()), features, s.bins)
    y = F.nanvl(F.col(target).cast("double"), F.lit(None))
    row = df.agg(F.avg(y).alias("m"), F.min(y).alias("a"), F.max(y).alias("b")).first()
    if row.m is None or row.a == row.b:
        return Ensemble(features, edges, row.m or 0.0)
    model = Ensemble(features, edges, float(f"{row.m:.9g}"))
    scale = STEPS / max(row.b - model.base, model.base - row.a)
    blocks = written(pack(df, features, target, key, edges, model.base), "boosting")
    pending: list[Tree] = []
    for number in range(s.trees):
        used = columns_of(features, number, s)

        def evaluate(tree: Tree, ask: dict[int, int], used=used, number=number) -> dict:
            slot = np.full(len(tree.left), -1, dtype=np.int64)
            slot[list(ask.values())] = np.arange(len(ask))
            found = _best(_sums(blocks, len(features), used, list(pending), tree, slot, scale, s.seed * 100_003 + number, s.rows), s, scale).collect()
            return picked(found, list(ask))

        tree = _grow(evaluate, s, lambda x: -s.rate * (x.g / scale) / (x.n + s.penalty))
        if len(tree.left) == 1:
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH and number + 1 < s.trees:
            blocks = written(_refreshed(blocks, len(features), list(pending)), "boosting")
            pending = []
    return model


def picked(found: list, ask: list[int]) -> dict[int, tuple[int, int, _Split | None]]:
    """The best split of each node over features; of equal gains the first feature."""
    out: dict[int, tuple[int, int, _Split | None]] = {}
    for r in sorted(found, key=lambda r: r.feature):
        n, g, best = out.get(ask[r.slot], (r.n, r.g, None))
        if r.gain is not None and (best is None or r.gain > best.gain):
            best = _Split(r.gain, r.feature, r.bin, r.missing_left, r.n_left, r.g_left)
        out[ask[r.slot]] = (n, g, best)
    return out


def _refreshed(blocks: DataFrame, features: int, pending: list[Tree]) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for k in range(batch.num_rows):
                bins, _, now, _ = _opened(batch, k, features)
                for t in pending:
                    now = now + t(bins)
                new.append(now.tobytes())
            yield pa.RecordBatch.from_arrays([batch["n"], batch["bins"], batch["y"], pa.array(new, pa.binary()), batch["mark"]], schema=schema)

    return blocks.mapInArrow(run, _BLOCKS)
