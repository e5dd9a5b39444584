"""A Merkle manifest of a data set: one root for all rows, a proof for each row, and a check of changed rows.

Rows are leaves of a tree for each language, and the languages' subroots are the leaves of one tree above them.  A
stretch of neighbouring leaves is folded into a sparse forest: the nodes that can't be resolved yet, keyed by tree, level
and index.  Forests merge by uniting their nodes and resolving every sibling run that is now complete, which is
associative, so stretches are folded where they lie and merged by a tree of reductions over neighbours; as the number of
leaves of each tree is known, so is the length of every run.  Between stretches only unresolved nodes travel, about two
for each level.  On the way back each stretch fetches the few nodes beside its own that its proofs need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .sharding import number_rows
from .workspace import materialise, renamed

#: Nodes of a run; leaves of a stretch; stretches, or groups of them, that one reduction merges.
ARITY, STRETCH, FAN = 2, 8192, 32
#: The number of the tree above the languages; theirs are from 0.
TOP = -1

#: A node is (tree, level, index).
Node = tuple[int, int, int]


def digest(parts: list[bytes]) -> bytes:
    """The node above a run: the hash of its digests as text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // ARITY**level)


def above(node: Node, sizes: dict[int, int]) -> tuple[list[Node], Node | None]:
    """The node's run, itself included, and the node that it makes: None for the root of all."""
    tree, level, index = node
    width = _width(sizes[tree], level)
    if width == 1:
        return [node], None if tree == TOP else (TOP, 0, tree)
    first = index - index % ARITY
    return [(tree, level, k) for k in range(first, min(first + ARITY, width))], (tree, level + 1, index // ARITY)


def settle(forest: dict[Node, bytes], sizes: dict[int, int]) -> tuple[dict[Node, bytes], dict[Node, bytes]]:
    """The nodes of a forest that no complete run takes up, and all that were made on the way.

    ``sizes`` tells the leaves of each tree.  A subroot is the leaf of the top tree as it is, without another hash.
    """
    left, made = dict(forest), {}
    todo = list(forest)
    while todo:
        node = todo.pop()
        if node not in left:
            continue
        run, parent = above(node, sizes)
        if parent is None or any(n not in left for n in run):
            continue
        parts = [left.pop(n) for n in run]
        made[parent] = left[parent] = parts[0] if parent[:2] == (TOP, 0) else digest(parts)
        todo.append(parent)
    return left, made


def merge(a: dict[Node, bytes], b: dict[Node, bytes], sizes: dict[int, int]) -> dict[Node, bytes]:
    """The product of two settled forests of different leaves: associative, with the empty forest as its unit."""
    return settle({**a, **b}, sizes)[0]


def path(node: Node, sizes: dict[int, int]) -> Iterator[tuple[list[Node], int, Node]]:
    """From a node to the root of all: the siblings, the node's place among them, and the node above."""
    while True:
        run, parent = above(node, sizes)
        if parent is None:
            return
        yield [n for n in run if n != node], run.index(node), parent
        node = parent


def fold(leaf: bytes, node: Node, nodes: dict[Node, bytes], sizes: dict[int, int]) -> bytes:
    """The root that a leaf gives with the siblings of its place."""
    now = leaf
    for siblings, place, parent in path(node, sizes):
        parts = [nodes[n] for n in siblings]
        if parent[:2] != (TOP, 0):
            now = digest([*parts[:place], now, *parts[place:]])
    return now


def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its bytes' number, a colon and the bytes."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and changed (the leaf after tampering, null where the row isn't tampered with)."""
    plain = [field(F.col(c)) for c in ("doc_id", "source", "lang")]
    struck = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = lambda n: F.sha2(F.concat(*plain, field(n), field(F.col("text"))), 256)
    return docs.select("lang", "doc_id", leaf(F.col("n_chars")).alias("leaf"), F.when(struck, leaf(F.col("n_chars") + 1)).alias("changed"))


def _by_stretch(df: DataFrame, fn: Callable[[int, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each stretch and its rows, which are few; ``stretch`` and ``place`` order the rows."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = fn(held[0]["stretch"], held)
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["stretch"] != row["stretch"]:
                    yield from flush()
                held.append(row)
        if held:
            yield from flush()

    return df.repartition("stretch").sortWithinPartitions("stretch", "place").mapInArrow(run, schema)


_NODES = "stretch long, tree long, leaves long, level int, index long, hash string, open boolean"


def _forest(rows: list[dict], trees: int) -> tuple[dict[Node, bytes], dict[int, int]]:
    nodes = {(r["tree"], r["level"], r["index"]): r["hash"].encode() for r in rows}
    return nodes, {TOP: trees} | {r["tree"]: r["leaves"] for r in rows}


def _as_rows(stretch: int, nodes: dict[Node, bytes], sizes: dict[int, int], held: dict[Node, bytes]) -> list[tuple]:
    return [(stretch, t, sizes[t], level, index, h.decode(), (t, level, index) in held) for (t, level, index), h in nodes.items()]


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its leaf, subroot, root and proof, and what becomes of the root if some rows are tampered with.

    Leaves stand by lang (null first) and doc_id (null first); rows of the same id by their leaf, and equal rows, which
    are interchangeable, are leaves of their own.  An empty table gives an empty result, and other columns are ignored.
    Where 7 divides the checksum of the id, 1 is added to n_chars; a null id or n_chars isn't tampered with.
    """
    made = materialise(leaves(docs), "merkle-leaves")
    rows, total = number_rows(made, [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"], "merkle-rows", "place")
    langs = rows.groupBy("lang").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("leaves"))
    langs, trees = number_rows(langs, ["begin"], "merkle-trees", "tree")
    langs, of = renamed(materialise(langs, "merkle-langs"))
    # A small table of languages is broadcast by Spark itself, once its size is known from its files.
    placed = rows.join(langs, F.col("lang").eqNullSafe(of["lang"])).select(
        F.floor(F.col("place") / STRETCH).cast("long").alias("stretch"), "place", of["tree"].alias("tree"), of["leaves"].alias("leaves"), (F.col("place") - of["begin"]).alias("index"), "doc_id", "leaf", "changed",
    )
    placed = materialise(placed, "merkle-placed")

    def base(stretch: int, part: list[dict]) -> list[tuple]:
        sizes = {TOP: trees} | {r["tree"]: r["leaves"] for r in part}
        left, _ = settle({(r["tree"], 0, r["index"]): r["leaf"].encode() for r in part}, sizes)
        return _as_rows(stretch, left, sizes, left)

    def reduce(stretch: int, part: list[dict]) -> list[tuple]:
        nodes, sizes = _forest(part, trees)
        left, new = settle(nodes, sizes)
        return _as_rows(stretch, new | left, sizes, left)

    rounds = [materialise(_by_stretch(placed.select("stretch", "place", "tree", "leaves", "index", "leaf"), base, _NODES), "merkle-forests")]
    stretches = -(-total // STRETCH)
    while stretches > 1:
        stretches = -(-stretches // FAN)
        kept = rounds[-1].where("open").withColumns({"stretch": F.floor(F.col("stretch") / FAN).cast("long"), "place": F.lit(0)})
        rounds.append(materialise(_by_stretch(kept.drop("open"), reduce, _NODES), "merkle-forests"))

    # What each stretch lacks: the siblings of its unresolved nodes, and of all nodes above these.
    def lacking(stretch: int, part: list[dict]) -> list[tuple]:
        nodes, sizes = _forest(part, trees)
        out = {n for node in nodes for siblings, _, _ in path(node, sizes) for n in siblings}
        return [(stretch, *n) for n in out]

    first = rounds[0].withColumn("place", F.lit(0))
    needs = _by_stretch(first, lacking, "stretch long, tree long, level int, index long")
    spine = rounds[0].select("tree", "leaves", "level", "index", "hash")
    for more in rounds[1:]:
        spine = spine.unionByName(more.select("tree", "leaves", "level", "index", "hash"))
    spine, node = renamed(spine.dropDuplicates(["tree", "level", "index"]))
    beside = needs.join(spine, [F.col(c) == node[c] for c in ("tree", "level", "index")]).select("stretch", F.lit(-1).cast("long").alias("place"), "tree", node["leaves"].alias("leaves"), "level", "index", node["hash"].alias("leaf"))
    both = placed.withColumn("level", F.lit(0)).unionByName(beside, allowMissingColumns=True)

    def proofs(stretch: int, part: list[dict]) -> list[tuple]:
        sizes = {TOP: trees} | {r["tree"]: r["leaves"] for r in part}
        own = {(r["tree"], r["level"], r["index"]): r["leaf"].encode() for r in part}
        nodes = own | settle(own, sizes)[1]
        root = next(h for n, h in nodes.items() if above(n, sizes)[1] is None)
        out = []
        for r in part:
            if r["place"] < 0:
                continue
            at = (r["tree"], 0, r["index"])
            siblings = [nodes[n] for run, _, _ in path(at, sizes) for n in run]
            folded = fold((r["changed"] or r["leaf"]).encode(), at, nodes, sizes)
            out.append((r["doc_id"], r["leaf"], nodes[TOP, 0, r["tree"]].decode(), root.decode(), digest(siblings).decode(), folded.decode(), folded == root))
        return out

    return _by_stretch(both, proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
