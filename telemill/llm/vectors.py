"""Near-duplicate vectors: inverted lists with product-quantised residuals, and exact cosine.

Unit vectors are dealt to coarse lists; within a list, what is left of a vector after its list's centre is cut into
subspaces, each replaced by the nearest of 256 code words.  Every vector then probes the lists that can hold partners,
as its code alone: there, tables of inner products of each resident vector (which isn't quantised) with all code words
give its distances by look-up and sum.  A probe is passed on unless these, less the code's own error, prove that it is too
far from all residents, so quantisation loses nothing.  Only for probes that pass whole vectors are fetched, and cosine
in double precision decides.

Rows travel as packed arrays, thousands to a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .arrow import map_columns
from .blocks import Connected, map_groups
from .components import components
from .shingles import mix
from .workspace import materialise

#: Rows at most on which centres and code words are fitted, chosen by a hash; lists have LIST_ROWS rows on average, as
#: long as there are no more than MOST_LISTS (their centres are handed to every executor).
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 256, 4096
SUBSPACES, CODES = 16, 256
#: A list is probed if the vector is within this share of the distance of the plane halfway to the list's centre.  The
#: distances of two vectors of a pair from the plane between their lists add up to the distance at most, and a pair is
#: found if one of them probes the other's list, so half (and a little for rounding) loses nothing.
REACH = 0.5001
#: Residents of a list, and probes, that are compared in one task.
BLOCK, PROBES = 1024, 8192


@dataclass
class Index:
    centres: np.ndarray
    words: np.ndarray  # (subspaces, codes, dimensions of a subspace)
    pad: int  # dimensions of zeros that make the subspaces equal

    def residuals(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return x - self.centres[lists]

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), len(self.words), -1)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        parts = self.parts(residual)
        out = np.empty(parts.shape[:2], dtype=np.uint8)
        for m, words in enumerate(self.words):
            out[:, m] = ((words**2).sum(axis=1) - 2 * parts[:, m] @ words.T).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        joined = np.concatenate([words[codes[:, m]] for m, words in enumerate(self.words)], axis=1)
        return joined[:, : self.centres.shape[1]]

    def nearest(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the lists it probes (its own first)."""
        between = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2), 1e-12)) if len(self.centres) <= 256 else None
        home, probes = np.empty(len(x), np.int32), []
        norms = (self.centres**2).sum(axis=1)
        for at in range(0, len(x), 512):
            d = norms - 2 * x[at : at + 512] @ self.centres.T
            own = d.argmin(axis=1)
            home[at : at + 512] = own
            for k, o in enumerate(own):
                apart = between[o] if between is not None else np.sqrt(np.maximum(((self.centres - self.centres[o]) ** 2).sum(axis=1), 1e-12))
                reached = np.flatnonzero((d[k] - d[k, o]) / (2 * apart) <= REACH * radius)
                probes.append(np.concatenate(([o], reached[reached != o])).astype(np.int32))
        return home, probes


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((centres**2).sum(axis=1) - 2 * x[i : i + 2048] @ centres.T).argmin(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, seed: int = 7) -> Index:
    centres = kmeans(sample, max(1, lists), 8, seed)
    pad = -sample.shape[1] % subspaces
    index = Index(centres, np.zeros((subspaces, 1, (sample.shape[1] + pad) // subspaces)), pad)
    home = np.concatenate([((centres**2).sum(axis=1) - 2 * sample[i : i + 2048] @ centres.T).argmin(axis=1) for i in range(0, len(sample), 2048)])
    parts = index.parts(index.residuals(sample, home))
    index.words = np.stack([np.resize(kmeans(parts[:, m], CODES, 5, seed + m), (CODES, parts.shape[2])) for m in range(subspaces)])
    return index


def units(values: list) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Unit vectors in double precision; None for what is null, empty, zero, or holds a null or non-finite number."""
    out: list[np.ndarray | None] = []
    for v in values:
        x = None
        if v is not None and len(v) and all(c is not None for c in v):
            x = np.array(v, dtype=np.float64)
            largest = np.abs(x).max() if np.isfinite(x).all() else 0.0
            x = x / largest if largest > 0 else None
            x = x / np.sqrt(x @ x) if x is not None else None
        out.append(x)
    return np.array([x is not None for x in out], dtype=bool), out


def _distinct(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(id, unit) of all rows and one row (node, dims, unit, copies, least id) for each distinct unit vector."""

    def run(cols: dict) -> dict:
        _, u = units(cols["v"])
        return {"id": cols["id"], "unit": [None if x is None else x.tobytes() for x in u]}

    rows = materialise(map_columns(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")), run, "id long, unit binary"), "units")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    return rows, materialise(classes.withColumn("node", F.monotonically_increasing_id()), "unit-classes")


def _packed(node: np.ndarray, **fields: np.ndarray) -> bytes:
    """Arrays of equal length as bytes, one after the other; ``_unpacked`` takes their types and widths again."""
    return b"".join([np.int64(len(node)).tobytes(), node.astype("<i8").tobytes(), *[np.ascontiguousarray(x).tobytes() for x in fields.values()]])


def _unpacked(data: bytes, fields: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    out, at = {"node": np.frombuffer(data, "<i8", n, 8)}, 8 + 8 * n
    for name, kind, width in fields:
        x = np.frombuffer(data, kind, n * width, at)
        out[name] = x.reshape(n, width) if width > 1 else x
        at += x.nbytes
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


class Layout:
    """What packed rows hold: residents with their vectors and the lists that they probe (as bits), probes with codes."""

    def __init__(self, dims: int, lists: int, subspaces: int):
        self.bits = -(-lists // 8)
        self.residents = [("copies", "<i8", 1), ("unit", "<f8", dims), ("reach", "u1", self.bits)]
        self.probes = [("home", "<i4", 1), ("least", "<f4", 1), ("codes", "u1", subspaces)]
        # One dimension or list keeps its axis.
        self.shape = {"unit": dims, "reach": self.bits, "codes": subspaces}

    def read(self, data: list[bytes], probes: bool) -> dict[str, np.ndarray]:
        out = _joined([_unpacked(d, self.probes if probes else self.residents) for d in data])
        return {k: x.reshape(len(x), self.shape[k]) if k in self.shape else x for k, x in out.items()}


def _near_probes(index: Index, here: int, residents: dict, probes: dict) -> np.ndarray:
    """Which probes may be near a resident of the list.

    With |x| = 1, |x - q|**2 is 1 + |q|**2 - 2 x.q, and x.q for a coded q is x.(its home's centre) and a sum of inner
    products of x with code words, which come from one table for each resident.  ``least`` is what a pair must reach.
    """
    x, node = residents["unit"], residents["node"]
    parts = index.parts(x)
    tables = [np.ascontiguousarray((words @ parts[:, m].T).astype(np.float32)) for m, words in enumerate(index.words)]
    centres = (index.centres @ x.T).astype(np.float32)
    order = np.argsort(node)
    out = np.empty(len(probes["node"]), dtype=bool)
    step = max(64, (1 << 19) // len(x))
    for at in range(0, len(out), step):
        q = slice(at, at + step)
        product = centres[probes["home"][q]]
        for m, table in enumerate(tables):
            product += table[probes["codes"][q, m]]
        # A resident is no partner of itself.
        place = np.minimum(np.searchsorted(node, probes["node"][q], sorter=order), len(node) - 1)
        mine = order[place]
        same = np.flatnonzero((node[mine] == probes["node"][q]) & (probes["home"][q] == here))
        product[same, mine[same]] = -2
        out[q] = (product >= probes["least"][q][:, None]).any(axis=1)
    return out


def _exact(residents: dict, node: np.ndarray, unit: np.ndarray, copies: np.ndarray, home: np.ndarray, cosine: float) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Spanning links, and how many rows each vector is linked with, that one task's group finds.

    A pair of which both vectors probe the other's list is found twice; it counts for the vector that probed.  If only
    one of them does, its find counts for both.
    """
    both, place = np.unique(np.concatenate((residents["node"], node)), return_inverse=True)
    base, query = place[: len(residents["node"])], place[len(residents["node"]) :]
    connected = Connected(both)
    counts = np.zeros(len(both), dtype=np.int64)
    x = residents["unit"]
    for at in range(0, len(query), 256):
        q = np.arange(at, min(at + 256, len(query)))
        a, b = np.nonzero(unit[q] @ x.T >= cosine - 1e-9)
        a = q[a]
        good = (np.einsum("ij,ij->i", unit[a], x[b]) >= cosine) & (query[a] != base[b])
        a, b = a[good], b[good]
        np.add.at(counts, query[a], residents["copies"][b])
        back = residents["reach"][b, home[a] >> 3] >> (home[a] & 7).astype(np.uint8) & 1
        one_way = back == 0
        np.add.at(counts, base[b[one_way]], copies[a[one_way]])
        new = connected.label[query[a]] != connected.label[base[b]]
        for i, j in zip(query[a[new]].tolist(), base[b[new]].tolist(), strict=True):
            connected.join(i, j)
    return connected.links, _summed(both, counts)


def _summed(node: np.ndarray, counts: np.ndarray) -> dict[int, int]:
    """Counts by node; a vector may stand in a group both as a base and as a query."""
    some = np.flatnonzero(counts)
    ids, at = np.unique(node[some], return_inverse=True)
    sums = np.zeros(len(ids), dtype=np.int64)
    np.add.at(sums, at, counts[some])
    return dict(zip(ids.tolist(), sums.tolist(), strict=True))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    n_links counts other rows at a cosine of at least ``cosine`` (equal vectors included); component_id is the smallest
    id that links reach (the own one included).  Null, empty and zero vectors, and such with null or non-finite
    components, link with nothing; vectors of other lengths than the most frequent one are compared among themselves
    by the same way.  Repeated rows link with each other; a null id gets component_id null unless links reach another;
    an empty table gives no rows; other columns are ignored.
    """
    rows, classes = _distinct(vectors, id_column, column)
    links, counts = None, None
    # A proper table has one length; each that more than one vector has gets an index of its own.
    sizes = classes.groupBy(F.octet_length("unit").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    for (size,) in sizes.select("size").collect():
        a, b = _search(classes.where(F.octet_length("unit") == size), cosine)
        links, counts = (a, b) if links is None else (links.unionByName(a), counts.unionByName(b))
    out = rows.join(classes.select("unit", "node", "copies", "least"), "unit", "left")
    if links is None:
        n = F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long")
        first = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
        return out.select(F.col("id").alias("vec_id"), n.alias("n_links"), first.alias("component_id"), F.col("id").eqNullSafe(first).alias("kept"))
    found = components(links, "vector-components")
    named = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = named.join(least, "component").select("node", "component_id").join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
    out = out.join(per_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    n = F.when(F.col("node").isNull(), 0).otherwise(F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    return out.select(F.col("id").alias("vec_id"), n.cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _search(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and (node, n) to be summed, among the distinct unit vectors of one length."""
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).select("unit").collect()
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in picked), dtype=np.float64).reshape(len(picked), -1)
    index = fit(sample, min(MOST_LISTS, -(-total // LIST_ROWS), len(sample)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    shared = classes.sparkSession.sparkContext.broadcast(index)
    lists = len(index.centres)
    layout = Layout(sample.shape[1], lists, len(index.words))
    residents_at_once, probes_at_once = BLOCK, PROBES

    def deal(cols: dict) -> dict:
        """Per list of a slice, its residents (role 0) and the vectors that probe it (role 1), packed."""
        x = np.frombuffer(b"".join(cols["unit"]), dtype=np.float64).reshape(len(cols["unit"]), -1)
        node, copies = np.array(cols["node"], dtype=np.int64), np.array(cols["copies"], dtype=np.int64)
        home, probes = shared.value.nearest(x, radius)
        residual = shared.value.residuals(x, home)
        codes = shared.value.encode(residual)
        coded = shared.value.decode(codes)
        error = np.sqrt(((residual - coded) ** 2).sum(axis=1))
        # The least inner product of a unit vector with the coded one at which the two may be near, less what rounding may take.
        least = ((1 + ((coded + shared.value.centres[home]) ** 2).sum(axis=1) - (radius + error) ** 2) / 2 - 1e-4).astype("<f4")
        reached = np.zeros((len(x), 8 * layout.bits), dtype=np.uint8)
        who, to = np.repeat(np.arange(len(x)), [len(p) for p in probes]), np.concatenate(probes)
        reached[who, to] = 1
        reach = np.packbits(reached, axis=1, bitorder="little")
        out: dict[str, list] = {k: [] for k in ("list", "role", "n", "data")}
        for role, rows, at in ((0, np.arange(len(x)), home), (1, who, to)):
            order = np.argsort(at, kind="stable")
            names, begins = np.unique(at[order], return_index=True)
            for k, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                r = rows[order[a:b]]
                data = _packed(node[r], copies=copies[r], unit=x[r], reach=reach[r]) if role == 0 else _packed(node[r], home=home[r].astype("<i4"), least=least[r], codes=codes[r])
                for name, v in zip(out, (k, role, len(r), data), strict=True):
                    out[name].append(v)
        return out

    dealt = materialise(map_columns(classes.select("node", "copies", "unit"), deal, "list int, role int, n long, data binary"), "vector-lists")
    # Two numbers for each list, of which there are MOST_LISTS at most.
    held = dealt.groupBy("list").agg(F.sum(F.when(F.col("role") == 0, F.col("n")).otherwise(0)).alias("residents"), F.sum(F.when(F.col("role") == 1, F.col("n")).otherwise(0)).alias("probes"))
    cells = {r["list"]: (-(-r["residents"] // residents_at_once), -(-r["probes"] // probes_at_once)) for r in held.collect()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each packed row's vectors by the block that a hash of their node gives, for all blocks of the other role."""
        for batch in batches:
            for here, role, data in zip(batch["list"].to_pylist(), batch["role"].to_pylist(), batch["data"].to_pylist(), strict=True):
                own, others = cells[here][role], cells[here][1 - role]
                if not others:
                    continue
                whole = layout.read([data], bool(role))
                block = (mix(whole["node"].view(np.uint64)) % np.uint64(own)).astype(np.int64)
                for k in range(own) if own > 1 else (0,):
                    use = np.flatnonzero(block == k)
                    if not len(use):
                        continue
                    part = data if own == 1 else _packed(whole["node"][use], **{n: x[use] for n, x in whole.items() if n != "node"})
                    for j in range(others):
                        i, j2 = (k, j) if role == 0 else (j, k)
                        yield pa.RecordBatch.from_pylist([{"list": here, "i": i, "j": j2, "role": role, "data": part}], schema=split_arrow)

    split_schema = "list int, i int, j int, role int, data binary"
    split_arrow = to_arrow_schema(_parse_datatype_string(split_schema))
    groups = ["list", "i", "j"]

    def passing(group: tuple, columns: dict) -> list[tuple]:
        sides = [[d for d, r in zip(columns["data"], columns["role"], strict=True) if r == role] for role in (0, 1)]
        if not sides[0] or not sides[1]:
            return []
        residents, probes = layout.read(sides[0], False), layout.read(sides[1], True)
        near = _near_probes(shared.value, group[0], residents, probes)
        return [(*group, n, h) for n, h in zip(probes["node"][near].tolist(), probes["home"][near].tolist(), strict=True)]

    blocks = dealt.mapInArrow(split, split_schema)
    passed = materialise(map_groups(blocks, groups, passing, "list int, i int, j int, node long, home int"), "vector-candidates")

    # Whole vectors of the probes that pass, and the residents of the groups in which one does.
    vectors = classes.select("node", "copies", "unit").join(passed, "node").select(*groups, F.lit(1).alias("role"), F.col("unit").alias("data"), "node", "copies", "home")
    members = dealt.where("role = 0").mapInArrow(split, split_schema).join(passed.select(*groups).distinct(), groups, "left_semi")
    members = members.select(*groups, "role", "data", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("int").alias("home"))

    def decide(group: tuple, columns: dict) -> list[tuple]:
        is_probe = np.array(columns["role"]) == 1
        data = columns["data"]
        residents = layout.read([data[k] for k in np.flatnonzero(~is_probe)], False)
        at = np.flatnonzero(is_probe)
        unit = np.frombuffer(b"".join([data[k] for k in at]), dtype=np.float64).reshape(len(at), -1)
        node, copies, home = (np.array([columns[c][k] for k in at], dtype=np.int64) for c in ("node", "copies", "home"))
        links, counts = _exact(residents, node, unit, copies, home, cosine)
        return [(a, b, None) for a, b in links] + [(a, None, n) for a, n in counts.items()]

    found = materialise(map_groups(members.unionByName(vectors), groups, decide, "a long, b long, n long"), "vector-links")
    return found.where("b is not null").select("a", "b"), found.where("b is null").select(F.col("a").alias("node"), "n")
