"""Repeated lines across documents, equal or a few edits apart: a segment-partition edit join.

Lines are compared as UTF-8 bytes without blanks around them; a line is known by the 128 bits of its xxh3 hash.  If two
lines are at most t edits apart and the shorter is cut into t + 1 segments of nearly equal length, one segment stands
unchanged in the longer, shifted by no more than the edits before and after it allow.  So each line is indexed by its
segments (with its length and the segment's number), and probes, for each length that a partner may have, the
substrings at allowed places.

What shares a key is compared, on its bytes, in groups of bounded size, and only verified links leave a group.  A key
of a segment that very many lines have in common is replaced: what is left of two such lines without it is at most t
edits apart too, so the same index over the rest, below that key, loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from telemill.sources.io import quoted

from .arrow import map_columns, slices
from .blocks import Connected, map_groups
from .components import components
from .meetings import Frequent, distinct, runs, shared_keys
from .shingles import Prefixes, mix
from .workspace import bitmap, in_bitmap, marks, materialise, renamed, split_by_marks

#: Edits that lines may be apart, and bytes that a line must have for that (and to be looked at, unless ``equal`` is less).
EDITS, LEAST = 2, 20
#: Lines that share a key, and their bytes, that are compared with as many others at once.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: A key is hot if it has more than this number of rows and a larger share of all than one in SHARE (about).
HOT_ROWS, SHARE = 1024, 4096
#: Rows of a hot key that may come together in one task.
CELL = 1 << 20
#: Rows with which any other key gives way too, whatever its share of all is.
OVERFULL = 1 << 17
#: Bits of the bitmap of lines that share a key.
LINE_MARKS = 1 << 26
_BLANKS = b" \t\r\x0b\x0c"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The bit that tells keys below a hot key from those of whole lines.
_BELOW = np.uint64(1)


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift of the substring against the segment) of every probe.

    With i - 1 segments before segment i wrong at least once each, and the others after it, only these shifts remain.
    """
    out = []
    for difference in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, difference - (edits - i)), min(i, difference + (edits - i))
            out += [(difference, i, shift) for shift in range(low, high + 1)]
    return out


def split_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, and of each of their lines: text number, number in the text, start and end without blanks."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    text = np.searchsorted(begins, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, begins[:-1])[text]
    # The first and last place in a line that isn't blank, however many blanks there are.
    solid = np.flatnonzero(~np.isin(buf, np.frombuffer(_BLANKS, np.uint8)))
    first = solid[np.searchsorted(solid, starts)]  # a line's end isn't blank
    last = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)]
    starts = np.minimum(first, ends)
    ends = np.where(last >= starts, np.minimum(last + 1, ends), starts)
    return buf, text, number, starts, ends


def _key(hashes: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
    salt = np.array([segment + 1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(hashes + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) & ~_BELOW


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of these lengths; the later segments get the bytes that are left over."""
    parts = edits + 1
    size = length // parts
    longer = length % parts
    first_longer = parts - longer
    return size * i + np.maximum(i - first_longer, 0), size + (i >= first_longer)


def keys(sums: Prefixes, starts: np.ndarray, ends: np.ndarray, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(lines, edits + 1) keys under which lines are indexed, and (lines, probes) keys that they probe.

    A probe that would leave the line, or a partner's length below 1, repeats the line's first probe.
    """
    length = ends - starts
    index = []
    for i in range(edits + 1):
        at, size = segment(length, i, edits)
        index.append(_key(sums.hashes(starts + at, starts + at + size), length, i))
    probe = []
    for difference, i, shift in windows(edits):
        at, size = segment(length - difference, i, edits)
        a = starts + at + shift
        ok = (at + shift >= 0) & (a + size <= ends) & (length > difference)
        a, b = np.where(ok, a, starts), np.where(ok, a + size, starts)
        k = _key(sums.hashes(a, b), length - difference, i)
        probe.append(np.where(ok, k, probe[0]) if probe else k)
    return np.stack(index, axis=1), np.stack(probe, axis=1)


def within_edits(a: bytes, b: bytes, most: int) -> int:
    """The edit distance of a and b if it is ``most`` or less, else ``most + 1``.

    What both begin and end with is left out.  Then the band of 2 * most + 1 diagonals of the distance table is gone
    through column by column, its vertical differences as two bit vectors that move down one row with every column.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    start, stop = 0, len(a)
    if a == b[:stop]:
        return len(b) - stop
    while a[start] == b[start]:
        start += 1
    back = 0
    while back < stop - start and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[start : stop - back], b[start : len(b) - back]
    m, n = len(a), len(b)
    if not m or n <= most:
        return n if not m else min(_small(a, b), most + 1)
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # Bit r of the band in column j is row j - most + r of the table (rows and columns from 0).
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << most) - 1), 0  # differences +1 and -1 between a row and the one above it
    at = min(most, m)  # distance in the last row of the band, on the lowest diagonal while it lies within the table
    last = 1 << (width - 1)
    for j in range(n):
        shift = j - most
        match = places.get(b[j], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        if j + most < m:
            at += not diagonal & last
        else:  # the band's end has left the table: follow its last row
            edge = 1 << (m - 1 - shift)
            at += bool(right & edge) - bool(left & edge)
        if at > 2 * most + n - m:  # what is left of the table can't make up for it
            return most + 1
        below = diagonal >> 1
        up, down = (left | ~(below | right)) & full, below & right
    return min(at, most + 1)


def _small(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def _lines_of(texts: list[str | None], least: int):
    """Of each line of at least ``least`` bytes: text number, number in it, bounds; and the buffer of all texts."""
    buf, text, number, starts, ends = split_lines(texts)
    ok = ends - starts >= least
    return buf, text[ok], number[ok], starts[ok], ends[ok]


def _identities(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, 2) signed 64-bit halves of each line's xxh3 hash of 128 bits."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)


def _node(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What finds a line again: 57 bits of its hash, 6 of its length's logarithm, and a free lowest bit.

    Lines that share it are told apart by their whole identity.
    """
    scale = np.frexp(length.astype(np.float64))[1].astype(np.uint64)
    return first.view(np.uint64) >> np.uint64(7) << np.uint64(7) | scale << np.uint64(1)


def _pairs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, edits: int, hot: tuple[np.ndarray, np.ndarray] | None = None, only: bool = False):
    """(keys, values) of all rows of the lines; a value is a line's node, with its lowest bit set where it is indexed.

    ``only``: of the rows that take the place of those with a hot key.
    """
    sums = Prefixes(buf)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]).any(axis=1)
    use = order[new]
    starts, ends = starts[use], ends[use]
    node = _node(np.ascontiguousarray(ids[use, 0]), ends - starts)
    index, probe = keys(sums, starts, ends, edits)
    ways = [(0, i, 0, True) for i in range(edits + 1)] + [(*w, False) for w in windows(edits)]
    out_keys, out_values = [], []
    for way, column in zip(ways, (*index.T, *probe.T), strict=True):
        if not way[3]:
            if way[0] == way[2] == 0:
                continue  # the line's own segment, under which it is indexed
            line = np.flatnonzero(column != index[:, 0])
        else:
            line = np.arange(len(starts))
        k, v = column[line], node[line] | np.uint64(way[3])
        if hot is not None and len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], k), len(hot[0]) - 1)
            is_hot = hot[0][at] == k
            if is_hot.any():
                more = _below(sums, starts, ends, line[is_hot], k[is_hot], hot[1][at[is_hot]], node, way, edits)
                out_keys += [x for x, _ in more]
                out_values += [x for _, x in more]
                k, v = k[~is_hot], v[~is_hot]
        if not only:
            out_keys.append(k)
            out_values.append(v)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(out_keys or none), np.concatenate(out_values or none)


def _below(sums, starts, ends, line, key, cells, node, way, edits) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows that take the place of rows with a hot key: keys of segments of what the line has beside the shared one."""
    difference, i, shift, indexed = way
    begin, end = starts[line], ends[line]
    at, size = segment(end - begin - difference, i, edits)
    left, after = at + shift, begin + at + shift + size
    rest = end - begin - size
    new_ways = [(0, j, 0, True) for j in range(edits + 1)] if indexed else []
    new_ways += [(d, j, s, False) for d, j, s in windows(edits) if d == difference and (s or not indexed)]
    out = []
    for d, j, s, is_indexed in new_ways:
        at2, size2 = segment(rest - d, j, edits)
        u, v = at2 + s, at2 + s + size2
        ok = (u >= 0) & (v <= rest) & (rest >= d)
        u, v, le, be, af = u[ok], v[ok], left[ok], begin[ok], after[ok]
        h = sums.joined(be + np.minimum(u, le), be + np.minimum(v, le), af + np.maximum(u - le, 0), af + np.maximum(v - le, 0))
        k = mix(h + mix(key[ok] + np.uint64(j + 1) * _ODD))
        value = node[line[ok]] | np.uint64(is_indexed)
        n = cells[ok]
        if len(n) and n.max() > 1:  # each pair of cells meets in a task of its own
            own = (mix(node[line[ok]]) % n.astype(np.uint64)).astype(np.int64)
            many = np.repeat(np.arange(len(k)), n)
            other = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
            low, high = np.minimum(own[many], other), np.maximum(own[many], other)
            k = mix(k[many] + mix((low * n[many] + high).astype(np.uint64) * _ODD))
            value = value[many]
        out.append((k | _BELOW, value))
    return out


def _lines(docs: DataFrame, edits: int, least: int, shortest: int) -> DataFrame:
    """One row for each line; also, with number -1, a frequent key (h1) and its count (h2), and, with -2, the number of
    key rows (h2), of each task."""
    schema = "doc_id long, text_hash long, number int, h1 long, h2 long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(4 * SHARE)
        for batch in batches:
            for part in slices(batch):
                buf, text, number, starts, ends = _lines_of(part["text"].to_pylist(), shortest)
                if not len(starts):
                    continue
                ids = _identities(buf, starts, ends)
                near = ends - starts >= least
                frequent.add(_pairs(buf, starts[near], ends[near], ids[near], edits)[0])
                columns = [part["doc_id"].take(pa.array(text)), part["text_hash"].take(pa.array(text)), pa.array(number, pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        hot, counts, total = frequent.result()
        some = counts >= max(2, total // (4 * SHARE))
        number = [-2] + [-1] * int(some.sum())
        none = pa.nulls(len(number), pa.int64())
        columns = [none, none, pa.array(number, pa.int32()), pa.array(np.append(np.uint64(0), hot[some]).view(np.int64)), pa.array(np.append(total, counts[some]))]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _hot(found: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many key rows there are, and the hot keys (sorted; 2 * SHARE at most) with the number of their cells."""
    total = found.where("number = -2").agg(F.sum("h2")).first()[0] or 0
    least = max(HOT_ROWS, total // (2 * SHARE))
    rows = found.where("number = -1").groupBy("h1").agg(F.sum("h2").alias("n")).where(F.col("n") >= least).toArrow()
    hot, n = rows["h1"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(hot)
    return total, (hot[order], -(-n[order] // CELL))


def _groups(keys_: np.ndarray, values: np.ndarray, block: int, overfull: float = float("inf")) -> dict[str, np.ndarray]:
    """Groups of bounded size of the lines that share keys: (g, node, side); left ones are compared with right ones.

    Side 0 is left, 1 right, 2 both.  A key of whole lines with more rows than ``OVERFULL`` only gives its number of rows
    as node, with side 3: it has to be treated as a hot one.  Keys below a hot one have nothing below them, so all of
    their lines are compared, however many they are.
    """
    keys_, values = distinct(keys_, values)
    one = np.uint64(1)
    node, indexed = values >> one << one, values & one
    begins, ends = runs(keys_)
    some = (np.maximum.reduceat(indexed, begins) == 1) & (node[begins] != node[ends - 1])
    scale = np.maximum.reduceat(node >> one & np.uint64(63), begins).astype(np.int64)
    most = np.clip(BLOCK_BYTES >> np.minimum(scale, 40), 1, block)
    over = some & (ends - begins > overfull) & (keys_[begins] & _BELOW == 0)
    some &= ~over
    small = ends - begins <= most
    use = np.repeat(some & small, ends - begins)
    g, nodes, sides = [keys_[use], keys_[begins[over]]], [node[use], (ends - begins)[over].astype(np.uint64)], [np.where(indexed[use] == 1, 2, 1), np.full(int(over.sum()), 3)]

    def add(key, where: tuple, members: np.ndarray, side: int) -> None:
        g.append(np.repeat(mix(key + mix(np.array([hash(where) & 0xFFFFFFFF], dtype=np.uint64))), len(members)))
        nodes.append(members)
        sides.append(np.full(len(members), side))

    for k in np.flatnonzero(some & ~small):
        a, b, key, size = begins[k], ends[k], keys_[begins[k]], int(most[k])
        left, right = node[a:b][indexed[a:b] == 1], node[a:b][indexed[a:b] == 0]
        lefts, rights = ([x[i : i + size] for i in range(0, len(x), size)] for x in (left, right))
        for i, x in enumerate(lefts):
            add(key, (i, i), x, 2)
            for j, y in enumerate([*lefts[i + 1 :], *rights], i + 1):
                add(key, (i, j), x, 0)
                add(key, (i, j), y, 1)
    return {"g": np.concatenate(g).view(np.int64), "node": np.concatenate(nodes).view(np.int64), "side": np.concatenate(sides).astype(np.int32)}


def _similar_lines(columns: dict, edits: int) -> list[tuple[int, int, int, int]]:
    """Links between the left and the right lines of a group, as many as connect what is linked."""
    place: dict[tuple[int, int], int] = {}
    number = [place.setdefault(x, len(place)) for x in zip(columns["h1"], columns["h2"], strict=True)]
    lines: list[bytes] = [b""] * len(place)
    is_left, is_right = np.zeros(len(place), bool), np.zeros(len(place), bool)
    for k, side, line in zip(number, columns["side"], columns["line"], strict=True):
        lines[k] = line
        is_left[k] |= side != 1
        is_right[k] |= side != 0
    left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
    size = np.array([len(x) for x in lines])
    # An edit changes the counts of two kinds of letters at most.
    letters = np.stack([np.bincount(np.frombuffer(x, np.uint8) & 31, minlength=32) for x in lines]) if len(lines) > 16 else None
    both = is_left & is_right
    ids, connected = list(place), Connected(np.arange(len(place)))
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        near = np.abs(size[some][:, None] - size[right]) <= edits
        near &= (some[:, None] < right) | ~both[some][:, None] | ~both[right]
        near &= some[:, None] != right
        if letters is not None:
            x, y = np.nonzero(near)
            for k in range(0, len(x), 1 << 14):
                i, j = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                near[i, j] = np.abs(letters[some[i]] - letters[right[j]]).sum(axis=1) <= 2 * edits
        for x, y in zip(*np.nonzero(near), strict=True):
            a, b = some[x], right[y]
            if not connected.already(a, b) and within_edits(lines[a], lines[b], edits) <= edits:
                connected.join(a, b)
    return [(*ids[a], *ids[b]) for a, b in connected.links]


def _near_links(docs: DataFrame, edits: int, least: int, total: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b) identities (h1, h2) of different lines at most ``edits`` apart, as many as connect what is so linked."""
    spark = docs.sparkSession
    texts = docs.select("text")
    block = BLOCK

    def meet(keys_: tuple[np.ndarray, np.ndarray], number: int, overfull: float, only: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(keys_)

        def pairs_of(part: pa.RecordBatch):
            buf, _, _, starts, ends = _lines_of(part["text"].to_pylist(), least)
            return _pairs(buf, starts, ends, _identities(buf, starts, ends), edits, shared.value, only)

        return materialise(shared_keys(texts, pairs_of, number, lambda k, v: (k, v), lambda k, v: _groups(k, v, block, overfull), "g long, node long, side int"), "line-groups")

    met = meet(hot, total, OVERFULL, False)
    over = met.where("side = 3").select("g", "node").toArrow()  # one of OVERFULL key rows at most
    if over.num_rows:
        more, n = over["g"].to_numpy().view(np.uint64), over["node"].to_numpy()
        order = np.argsort(more)
        met = met.where("side < 3").unionByName(meet((more[order], -(-n[order] // CELL)), 8 * int(n.sum()), float("inf"), True))
    wanted = spark.sparkContext.broadcast(bitmap(marks(met, F.col("node"), LINE_MARKS), LINE_MARKS))

    def fetch(cols: dict) -> dict:
        buf, _, _, starts, ends = _lines_of(cols["text"], least)
        ids = _identities(buf, starts, ends)
        node = _node(np.ascontiguousarray(ids[:, 0]), ends - starts).view(np.int64)
        use = np.flatnonzero(in_bitmap(wanted.value, node))
        _, first = np.unique(ids[use], axis=0, return_index=True) if len(use) else (None, use)
        use = use[first]
        raw = buf.tobytes()
        return {"node": node[use], "h1": ids[use, 0], "h2": ids[use, 1], "line": [raw[a:b] for a, b in zip(starts[use].tolist(), ends[use].tolist(), strict=True)]}

    found = map_columns(texts, fetch, "node long, h1 long, h2 long, line binary").groupBy("node", "h1", "h2").agg(F.min("line").alias("line"))
    members = met.join(found, "node").select("g", "side", "h1", "h2", "line")
    links = map_groups(members, ["g"], lambda _, columns: _similar_lines(columns, edits), "a1 long, a2 long, b1 long, b2 long")
    identity = lambda x: F.struct(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2")).alias(x)
    return links.select(identity("a"), identity("b"))


def repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST, equal: int | None = None) -> DataFrame:
    """doc_id, text_hash (xxhash64) and the numbers (from 0) of the lines that repeat an earlier one, of texts that have such.

    Lines, without blanks around them, of at least ``least`` bytes are linked if they are equal or at most ``edits``
    byte edits apart; of everything that links connect, the first line stays, in the order of doc_id (nulls last),
    text_hash and line.  Shorter lines of at least ``equal`` bytes (``least`` by default) repeat only equal ones, and what
    is shorter still always stays.  Rows with the same id, or none, are different documents.  Of rows
    with equal ids and texts the first has the lines in ``repeats``, the others those in ``later`` (else null).
    """
    table = materialise(_lines(docs, edits, least, least if equal is None else min(equal, least)), "lines")
    total, hot = _hot(table)
    lines = table.where("number >= 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "number")
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    found = components(_near_links(docs, edits, least, total, hot), "similar-lines").select("node.h1", "node.h2", "component")
    classes = classes.join(found, ["h1", "h2"], "left").where("n > 1 or component is not null")
    classes = materialise(classes, "line-classes")
    near = classes.where("component is not null")
    kept = near.groupBy("component").agg(F.min("first").alias("kept"))
    repeated = near.join(kept, "component").select("h1", "h2", "kept").unionByName(classes.where("component is null").select("h1", "h2", F.col("first").alias("kept")))
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")) & (F.col("number") == F.col("kept.number"))
    marked = lines.join(repeated, ["h1", "h2"]).select("doc_id", "text_hash", "number", F.when(~same, F.col("number")).alias("gone"))
    found = marked.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("gone")).alias("repeats"), F.array_sort(F.collect_set("number")).alias("later"), F.count(F.lit(1)).alias("n"))
    # A number that comes twice is that of a row with the same id and text, of which all lines are repeats.
    found = found.withColumn("later", F.when(F.col("n") > F.size("later"), F.col("later"))).drop("n")
    return found.where((F.size("repeats") > 0) | F.col("later").isNotNull())


def without_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST, equal: int | None = None) -> DataFrame:
    """The rows of ``docs`` without repeated lines in ``text``, and columns n_lines and n_repeats.

    No row is lost: a text of which nothing but repeats existed becomes empty.  A null text stays null and has 0 lines;
    an empty text has one, empty line; all other columns pass (n_lines and n_repeats are replaced); an empty table
    stays empty.
    """
    docs = docs.drop("n_lines", "n_repeats")
    columns = docs.columns
    found = materialise(repeats(docs, edits, least, equal), "repeats")
    # Texts without repeats, as most have none, needn't be shuffled.
    hits, rest = split_by_marks(docs, F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"])), marks(found, F.xxhash64("doc_id", "text_hash")))
    row = f"row_{uuid.uuid4().hex}"
    copies = found.where("later is not null").select("doc_id", "text_hash")
    copied = bool(copies.limit(1).count())
    if copied:
        hits = materialise(hits.withColumn(row, F.monotonically_increasing_id()), "rows")
        copies, of = renamed(copies)
        firsts = hits.join(copies, hits["doc_id"].eqNullSafe(of["doc_id"]) & (F.xxhash64(hits["text"]) == of["text_hash"]))
        firsts = firsts.groupBy(of["doc_id"].alias("first_id"), of["text_hash"].alias("first_hash")).agg(F.min(hits[row]).alias("first_row"))
        found = found.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")), "left")
        found = materialise(found.select("doc_id", "text_hash", "repeats", "later", "first_row"), "repeats")
    found, of = renamed(found)
    joined = hits.join(found, hits["doc_id"].eqNullSafe(of["doc_id"]) & (F.xxhash64(hits["text"]) == of["text_hash"]), "left")
    gone = of["repeats"]
    if copied:
        gone = F.when(hits[row] != of["first_row"], of["later"]).otherwise(gone)
    kept = F.array_join(F.filter(F.split(hits["text"], "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), hits["text"]).otherwise(kept)

    def done(source: DataFrame, rows: DataFrame, text, dropped) -> DataFrame:
        mine = source["text"]
        count = F.coalesce(F.length(mine) - F.length(F.replace(mine, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
        return rows.select(*[text.alias("text") if c == "text" else source[quoted(c)] for c in columns], count.alias("n_lines"), dropped.cast("long").alias("n_repeats"))

    dropped = F.when(hits["text"].isNull(), 0).otherwise(F.coalesce(F.size(gone), F.lit(0)))
    return done(hits, joined, text, dropped).unionByName(done(rest, rest, rest["text"], F.lit(0)))
