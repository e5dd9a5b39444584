"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join, confirmed on whole sets.

A document's signature has SYMBOLS minima of its shingle set, 16 bits of each.  Two signatures differ in at most LIMIT
symbols; cut into CHUNKS chunks, one chunk then differs in at most ``LIMIT // CHUNKS`` = 1 symbol (pigeonhole).  All
one-symbol errors are enumerated by leaving out each symbol of each chunk: every such pair shares a key of a chunk, the
left-out place and the other symbols.  So all pairs within LIMIT meet, whatever else.  A key gives one link for each of
its members, and of the members that one task has only one is shuffled.

What meets hangs together in families, for which one row a member is enough.  A large family is looked at once more: of
what shares a key in it, only pairs within LIMIT hold together, so documents that merely have a weak neighbour each fall
into small families of their own.  Small families are compared in one task each.  All members of one that is still large are first compared with a few of them, the pivots, on whole shingle sets; what hangs on
one group of connected pivots needs no comparison among itself, so only the others are compared with all, in blocks of
bounded size.  There pairs within LIMIT are confirmed on whole sets, inside the task, and only links that connect
something new leave it.  So neither pairs nor links are ever listed by the square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns
from .blocks import Connected, map_groups
from .components import components
from .meetings import Pairs, distinct, runs, shared_keys
from .shingles import mix, shingle_sets
from .workspace import marks, materialise, renamed, split_by_marks

SYMBOLS, CHUNKS, LIMIT = 40, 10, 19
WIDTH = SYMBOLS // CHUNKS
#: Members of a family, and hashes of their sets, that are compared with as many others at once.
BLOCK, BLOCK_HASHES = 1024, 1 << 20
#: Members of a large family with which all others are compared first.
PIVOTS = 16

_SEEDS = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _TERMS = _SEEDS[:SYMBOLS] | np.uint64(1), _SEEDS[SYMBOLS:]


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a non-empty set of 64-bit hashes, the low 16 bits of each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """For signatures (n, SYMBOLS) their keys (n, SYMBOLS): number of chunk and left-out place, and the other symbols."""
    s = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    out = np.zeros((len(s), CHUNKS, WIDTH), dtype=np.int64)
    for left_out in range(WIDTH):
        value = np.zeros((len(s), CHUNKS), dtype=np.int64)
        for j in range(WIDTH):
            if j != left_out:
                value = (value << 16) | s[:, :, j]
        out[:, :, left_out] = value + ((np.arange(CHUNKS) * WIDTH + left_out) << 16 * (WIDTH - 1))
    return out.reshape(len(s), SYMBOLS)


def _digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart: those of equal sets are equal."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set) and signature of each row; the last two null for an empty set."""

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "n_shingles": [], "digest": [], "signature": []}
        for s in shingle_sets(cols["text"]):
            out["n_shingles"].append(len(s))
            out["digest"].append(_digest(s) if len(s) else None)
            out["signature"].append(signature(s).astype("<u2").tobytes() if len(s) else None)
        return out

    return map_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def _key_pairs(part: pa.RecordBatch) -> Pairs:
    """(key, node) for each key of each class of equal sets."""
    keys = keys_of(np.frombuffer(b"".join(part["signature"].to_pylist()), "<u2").reshape(-1, SYMBOLS))
    return mix(keys.ravel().view(np.uint64)), np.repeat(part["node"].to_numpy(), SYMBOLS).view(np.uint64)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links from the smallest node of each key to its others, and the keys with their smallest nodes."""
    keys, nodes = distinct(keys, nodes)
    begins, ends = runs(keys)
    centre = np.repeat(nodes[begins], ends - begins)
    other = nodes != centre
    a, b = distinct(centre[other], nodes[other])
    return a, b, keys[begins], nodes[begins]


def _combined(keys: np.ndarray, nodes: np.ndarray) -> Pairs:
    """Each key with its smallest node; each link that this leaves out has a key of its own instead."""
    a, b, keys, least = _stars(keys, nodes)
    own = mix(mix(a) + b)
    return np.concatenate((keys, own, own)), np.concatenate((least, a, b))


def _met(keys: np.ndarray, nodes: np.ndarray) -> dict[str, np.ndarray]:
    a, b, _, _ = _stars(keys, nodes)
    return {"a": a.view(np.int64), "b": b.view(np.int64)}


def _key_groups(keys: np.ndarray, nodes: np.ndarray) -> dict[str, np.ndarray]:
    """What shares a key: (g, node, centre), where equal groups of several keys have the same g.

    A group of more than BLOCK members gives links from its smallest node (centre; else -1) instead.
    """
    keys, nodes = distinct(keys, nodes)
    begins, ends = runs(keys)
    size = ends - begins
    name = np.add.reduceat(mix(nodes), begins) if len(begins) else nodes
    group = np.repeat(mix(name + size.astype(np.uint64)), size)
    centre = np.repeat(np.where(size > BLOCK, nodes[begins].view(np.int64), -1), size)
    use = (np.repeat(size, size) > 1) & (centre != nodes.view(np.int64))
    group = np.where(centre < 0, group, np.uint64(0))
    # Of each group once in a bucket, and of each link.
    order = np.lexsort((nodes[use], centre[use], group[use]))
    g, node, c = group[use][order], nodes[use][order], centre[use][order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1]) | (c[1:] != c[:-1])
    return {"g": g[new].view(np.int64), "node": node[new].view(np.int64), "centre": c[new]}


def _far(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many symbols signatures differ: a matrix, for at most BLOCK by BLOCK of them."""
    far = np.zeros((len(sig), len(others)), dtype=np.uint8)
    for k in range(SYMBOLS):
        far += sig[:, k][:, None] != others[:, k][None, :]
    return far


def _near_pivots(columns: dict) -> list[tuple[int, int]]:
    """Links within LIMIT from pivots to each other, and from the first that is near to each other member of a block."""
    sig = np.frombuffer(b"".join(columns["signature"]), "<u2").reshape(-1, SYMBOLS)
    node, is_pivot = np.array(columns["node"]), np.array(columns["is_pivot"], dtype=bool)
    pivots, others = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
    among = np.argwhere(np.triu(_far(sig[pivots], sig[pivots]) <= LIMIT, 1))
    near = _far(sig[others], sig[pivots]) <= LIMIT
    hit = near.any(axis=1)
    first = pivots[near[hit].argmax(axis=1)]
    pairs = [(node[pivots[i]], node[pivots[j]]) for i, j in among] + list(zip(node[first], node[others[hit]], strict=True))
    return [(int(x), int(y)) for x, y in pairs]


def _near_signatures(columns: dict) -> list[tuple[int, int]]:
    """Links between labels that connect what pairs within LIMIT connect in a group; what has one label is connected."""
    sig = np.frombuffer(b"".join(columns["signature"]), "<u2").reshape(-1, SYMBOLS)
    names, start = np.unique(np.array(columns["label"]), return_inverse=True)
    if len(names) < 2:
        return []
    near = _far(sig, sig) <= LIMIT
    label = start.copy()
    while True:
        least = np.where(near, label[None, :], len(sig)).min(axis=1)
        of_name = np.full(len(names), len(sig))
        np.minimum.at(of_name, start, least)
        least = of_name[start]
        if (least == label).all():
            break
        label = least
    return [(int(names[x]), int(names[y])) for x, y in np.unique(np.stack((label, start), axis=1), axis=0).tolist() if x != y]


def _tight_families(large: DataFrame) -> DataFrame:
    """(node, family) of members of loose families (family, node, signature) that have a partner within LIMIT, or may have one.

    Members are first compared with a few of their family; what is near one of these needs no link of its own later on.
    """
    rows = large.select("family", "node", "signature")
    sizes = rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(sizes, "family").withColumn("is_pivot", (F.col("node") == F.col("family")) | (F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts") * max(1, BLOCK // PIVOTS)) == 0))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pivots = dealt.where("is_pivot").select("family", part.alias("i"), "node", "is_pivot", "signature")
    others = dealt.where("not is_pivot").select("family", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), "node", "is_pivot", "signature")
    star = materialise(map_groups(pivots.unionByName(others), ["family", "i"], lambda _, c: _near_pivots(c), "a long, b long"), "near-pivots")
    label = star.join(pivots.select(F.col("node").alias("b")).distinct(), "b", "left_anti").select(F.col("b").alias("node"), F.col("a").alias("label"))
    labelled = rows.select("node", "signature").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialise(labelled, "labelled")

    groups = shared_keys(labelled.select("node", "signature"), _key_pairs, labelled.count() * SYMBOLS, lambda k, v: (k, v), _key_groups, "g long, node long, centre long")
    groups = materialise(groups.distinct(), "key-groups")
    found = map_groups(groups.where("centre < 0").select("g", "node").join(labelled, "node").select("g", "node", "label", "signature"), ["g"], lambda _, c: _near_signatures(c), "a long, b long")
    name = labelled.select("node", "label")
    hubs = groups.where("centre >= 0").join(name, "node").select("centre", F.col("label").alias("b")).distinct()
    hubs = hubs.join(name.select(F.col("node").alias("centre"), F.col("label").alias("a")), "centre").select("a", "b")
    edges = star.unionByName(found).unionByName(hubs).where("a != b")
    return components(edges, "tight-families").withColumnRenamed("component", "family")


def _shared_counts(rows: list[np.ndarray], cols: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Sizes of all intersections of sorted distinct sets, as parts of one (rows, cols) matrix that add up to it."""
    values, number = np.unique(np.concatenate(rows + cols), return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(cols)), [len(x) for x in rows + cols])
    left = owner < len(rows)
    both = (np.bincount(number[left], minlength=len(values)) > 0) & (np.bincount(number[~left], minlength=len(values)) > 0)
    place = np.cumsum(both) - 1
    use = both[number]
    owner, at = owner[use], place[number[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = 4096
    for begin in range(0, int(both.sum()), step):
        a, b = np.searchsorted(at, (begin, begin + step))
        inside = np.zeros((len(rows) + len(cols), step), dtype=np.float32)
        inside[owner[a:b], at[a:b] - begin] = 1
        yield inside[: len(rows)] @ inside[len(rows) :].T


def _similar(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def links(columns: dict, i: int, j: int, percent: int = 75) -> list[tuple[int, int]]:
    """Links that connect what is linked between the blocks i and j (or within i) of a family: a spanning forest.

    Candidates are the pairs with at most LIMIT differing symbols.  Each is decided on whole sets unless its two
    documents are connected already: one by one if there are few, else all at once by a product of incidence matrices.
    """
    node, own, sets = np.array(columns["node"]), np.array(columns["own"]), columns["hashes"]
    sig = np.frombuffer(b"".join(columns["signature"]), "<u2").reshape(-1, SYMBOLS)
    n = np.array([len(x) for x in sets], dtype=np.int64)
    rows, cols = (np.flatnonzero(own == x) for x in (i, j))
    near = np.zeros((len(rows), len(cols)), dtype=bool)
    distance = np.zeros((len(rows), len(cols)), dtype=np.uint8)
    for at in range(0, len(rows), 64):
        r = rows[at : at + 64]
        far = distance[at : at + 64]
        for k in range(SYMBOLS):
            far += sig[r, k][:, None] != sig[cols, k][None, :]
        low, high = np.minimum(n[r][:, None], n[cols]), np.maximum(n[r][:, None], n[cols])
        near[at : at + 64] = (far <= LIMIT) & (100 * low >= percent * high)
    if i == j:
        near &= node[rows][:, None] < node[cols]
    pairs = int(near.sum())
    connected = Connected(node)
    if pairs * (15 + 0.04 * n.mean()) < 2e-4 * len(rows) * len(cols) * n.sum() / 50 + 1000:
        x, y = np.nonzero(near)
        order = np.argsort(distance[x, y], kind="stable")
        for a, b in zip(rows[x[order]].tolist(), cols[y[order]].tolist(), strict=True):
            if not connected.already(a, b):
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if _similar(shared, n[a], n[b], percent):
                    connected.join(a, b)
        return connected.links
    shared = np.zeros(near.shape, dtype=np.float64)
    for part in _shared_counts([sets[r] for r in rows], [sets[c] for c in cols]):
        shared += part
    near &= _similar(shared, n[rows][:, None], n[cols], percent)
    for k, a in enumerate(rows):
        for b in cols[near[k]]:
            connected.join(a, b)
    return connected.links


def _pivot_links(family: int, columns: dict, percent: int) -> list[tuple[int, int, int, bool]]:
    """(family, a, b, among pivots): each other row with the first pivot that it is linked to, and what links pivots."""
    pivots = [k for k, p in enumerate(columns["is_pivot"]) if p]
    node, sets = columns["node"], columns["hashes"]
    among, out = Connected(np.array([node[k] for k in pivots])), []
    for k, s in enumerate(sets):
        linked = []
        for j, p in enumerate(pivots):
            low, high = sorted((len(s), len(sets[p])))
            if k != p and 100 * low >= percent * high and _similar(len(np.intersect1d(s, sets[p], assume_unique=True)), len(s), len(sets[p]), percent):
                linked.append(j)
        if columns["is_pivot"][k]:
            linked.append(pivots.index(k))
        elif linked:
            out.append((family, node[pivots[linked[0]]], node[k], False))
        for j in linked[1:]:
            among.join(linked[0], j)
    return out + [(family, x, y, True) for x, y in among.links]


def _most_connected(columns: dict) -> list[int]:
    """The largest group of connected pivots of a family."""
    nodes, place = np.unique(columns["a"] + columns["b"], return_inverse=True)
    connected = Connected(nodes)
    for x, y in zip(place[: len(columns["a"])], place[len(columns["a"]) :], strict=True):
        connected.join(x, y)
    label, n = np.unique(connected.label, return_counts=True)
    return nodes[connected.label == label[n.argmax()]].tolist()


def _links_within(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each family: members have family, blocks, node, signature, hashes.

    A family is named by its smallest node.
    """
    one = F.lit(0).alias("own")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    small = members.where("blocks = 1").select("family", "node", one, "signature", "hashes")
    small = map_groups(small, ["family"], lambda _, c: links(c, 0, 0, percent), "a long, b long")

    # About PIVOTS members of a large family, the first among them, by a hash.
    large = members.where("blocks > 1").withColumn("is_pivot", (F.col("node") == F.col("family")) | (F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks") * max(1, BLOCK // PIVOTS)) == 0))
    pivots = large.where("is_pivot").select("family", each("blocks").alias("i"), "node", "is_pivot", "hashes")
    others = large.where("not is_pivot").select("family", block("blocks").alias("i"), "node", "is_pivot", "hashes")
    star = map_groups(pivots.unionByName(others), ["family", "i"], lambda g, c: _pivot_links(g[0], c, percent), "family long, a long, b long, among boolean")
    star = materialise(star, "pivot-links")

    # What hangs on one group of connected pivots needs no comparison among itself.
    among = star.where("among").select("family", "a", "b").distinct()
    main = map_groups(among, ["family"], lambda g, c: [(g[0], n) for n in _most_connected(c)], "family long, pivot long")
    alone = large.where("node = family").select("family").join(among.select("family").distinct(), "family", "left_anti").select("family", F.col("family").alias("pivot"))
    main = materialise(main.unionByName(alone), "main-pivots")
    settled = star.where("not among").join(main.select(F.col("pivot").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).unionByName(main.select(F.col("pivot").alias("node")))
    marked = large.join(settled.withColumn("settled", F.lit(True)), "node", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    needed = lambda of: F.ceil(F.greatest(F.count_if(of) / BLOCK, F.sum(F.when(of, F.size("hashes")).otherwise(0)) / BLOCK_HASHES)).cast("int")
    sizes = marked.groupBy("family").agg(needed(~F.col("settled")).alias("rest_blocks"), needed(F.col("settled")).alias("settled_blocks")).where("rest_blocks > 0")
    marked = marked.select("family", "node", "settled", "signature", "hashes").join(sizes, "family")
    row = ["node", "own", "signature", "hashes"]
    # The rest among itself: each pair of its blocks in one task.
    rest = marked.where("not settled").withColumns({"own": block("rest_blocks"), "other": each("rest_blocks")})
    rest = rest.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *row)
    # And with what is settled, whose blocks are numbered from -1 downwards.
    crossed = marked.where("settled_blocks > 0")
    left = crossed.where("not settled").withColumns({"own": block("rest_blocks"), "other": each("settled_blocks")}).select("family", F.col("own").alias("i"), (-1 - F.col("other")).alias("j"), *row)
    right = crossed.where("settled").withColumns({"own": -1 - block("settled_blocks"), "other": each("rest_blocks")}).select("family", F.col("other").alias("i"), F.col("own").alias("j"), *row)
    found = map_groups(rest.unionByName(left).unionByName(right), ["family", "i", "j"], lambda g, c: links(c, g[1], g[2], percent), "a long, b long")
    return small.unionByName(star.select("a", "b")).unionByName(found)


def _found(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, digest and first, the first row of its component.

    first is a struct of last (doc_id is null), doc_id and text_hash, by which rows are ordered; it is null for rows
    with an empty set.
    """
    rows = materialise(sketch(docs), "sketches")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("holder")
    classes = rows.where("digest is not null").groupBy("digest").agg(holder, F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # Families: what hangs together by shared keys.
    met = shared_keys(classes.select("node", "signature"), _key_pairs, classes.count() * SYMBOLS, _combined, _met, "a long, b long")
    family = components(met, "families").withColumnRenamed("component", "family")
    family = materialise(family.join(classes, "node"), "family-members")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_HASHES)).cast("int")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    loose = materialise(sizes.where(blocks > 1).select("family"), "loose-families")
    if loose.limit(1).count():
        tight = _tight_families(family.join(loose, "family", "left_semi")).join(classes, "node")
        family = materialise(family.join(loose, "family", "left_anti").unionByName(tight), "family-members")
        sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    wanted = family.join(sizes.select("family", blocks.alias("blocks")), "family").select("family", "blocks", "node", "holder", "digest", "signature")

    # Their whole sets, from the texts: a class is found again by the id and the hash of the text of one of its rows.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts, _ = split_by_marks(texts, F.xxhash64(texts["doc_id"], texts["text_hash"]), marks(family, F.xxhash64("holder.doc_id", "holder.text_hash")))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("holder.doc_id")) & (F.col("text_hash") == F.col("holder.text_hash")))
    texts = texts.select("family", "blocks", "node", "digest", "signature", "text")
    if rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])  # repeated rows

    def whole(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("family", "blocks", "node", "signature", "hashes")}
        for k, s in enumerate(shingle_sets(cols["text"])):
            if len(s) and _digest(s) == cols["digest"][k]:  # else another text with the same hash
                for name in ("family", "blocks", "node", "signature"):
                    out[name].append(cols[name][k])
                out["hashes"].append(s.view(np.int64))
        return out

    members = materialise(map_columns(texts, whole, "family long, blocks int, node long, signature binary, hashes array<long>"), "members")
    found = components(_links_within(members, percent), "components")
    linked = classes.select("node", "holder", "digest").join(found, "node", "left")
    alone = linked.where("component is null").select("digest", F.col("holder").alias("first"))
    linked = linked.where("component is not null")
    first = linked.groupBy("component").agg(F.min("holder").alias("first"))
    named = linked.join(first, "component").select("digest", "first").unionByName(alone)
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest")
    none = F.lit(None).cast(named.schema["first"].dataType).alias("first")
    return out.where("digest is not null").join(named, "digest").select(*out.columns, "first").unionByName(out.where("digest is null").select("*", none))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, digest.

    Documents are linked when their shingle sets have ``100 * intersection >= percent * union``; sets are linked if
    they are equal.  A null or wordless text has an empty set, which links with nothing.  component_id is the smallest
    doc_id (not null, if there is one) that can be reached; kept tells whether that is the row's own (null equals
    null).  Repeated rows are linked rows; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _found(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest")


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but the first row of each group of near-duplicates.

    First is the row with the smallest id (null at last), of such with equal ids that with the smallest hash of its
    text, and of rows with equal ids and texts any one.  A row with a null or wordless text stays.  An empty table
    stays empty.
    """
    found = materialise(_found(docs, percent).where("digest is not null"), "near-duplicates")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"))
    rows = materialise(rows.where("not stays or n > 1"), "not-first")
    hits, rest = split_by_marks(docs, F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"])), marks(rows, F.xxhash64("doc_id", "text_hash")))
    rows, of = renamed(rows)
    same = hits["doc_id"].eqNullSafe(of["doc_id"]) & (F.xxhash64(hits["text"]) == of["text_hash"])
    left = rest.unionByName(hits.join(rows, same, "left_anti"))
    repeated = rows.where(of["stays"])
    if not repeated.limit(1).count():
        return left
    return left.unionByName(hits.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
