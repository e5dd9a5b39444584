"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

All segmentations of a text are the paths through a lattice whose edges are pieces with scores; a path's score is its
sum.  A forward Viterbi pass gives, for every position, the best score from the beginning to there.  A search that
starts at the end and goes backwards has thereby an exact estimate of what is still to come, so A* takes nothing but
what leads to the next best path, and yields paths in falling order.  As the estimate is exact, each entry of its queue
stands for at least one path of that score, and no two for the same: for N paths a queue of N entries is enough.

Where no piece can reach across a position, every path goes through it.  The lattice falls apart there, and its N best
are those of sums over independent parts: a part's forward pass also tells how much its second best path loses, and
only the N - 1 parts that lose least can differ from their best in any of the N best, so A* runs on them alone.

The scores of a model of the BPE type are negated ranks, not logarithms of probabilities: there the best segmentation
by their sum (few, frequent pieces) isn't the one that the model's merges give, which ``merged`` returns.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_columns

BEST = 4
BLANK = "▁"
#: Parts whose result is remembered at once; longer ones than LONG characters are gone through one by one.
REMEMBERED, LONG = 1_000_000, 48
#: An unknown character scores so much less than the worst single character.
UNKNOWN_PENALTY = 10.0


class Lattice:
    """Pieces, scores and ids of a model (identity normalisation, blanks kept, a blank put before the text)."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text: list[str] = []
        self.byte = {}
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_of: dict[int, int] = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            plain = not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
            self.text.append(piece if plain else "")
            if m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            if plain:
                self.scores[piece], self.ids[piece] = m.get_score(i), i
        #: The bytes that an id stands for.
        self.bytes_of = {i: bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)}
        self.n_bytes = np.array([len(self.bytes_of[i]) for i in range(len(self.text))], dtype=np.int64)
        #: What an id stands for alone.
        self.whole = {i: chr(self.byte_of[i]) if i in self.byte_of else t for i, t in enumerate(self.text) if self.byte_of.get(i, 0) < 128}
        self.unknown_id = m.unk_id()
        self.unknown = min(s for p, s in self.scores.items() if len(p) == 1) - UNKNOWN_PENALTY
        self.packed_ids = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self._tables()
        #: The same as a tree: character to (score or None, what follows).
        self.tree: dict[str, list] = {}
        for piece, score in self.scores.items():
            at, node = self.tree, None
            for c in piece:
                node = at.setdefault(c, [None, {}])
                at = node[1]
            node[0] = score
        #: The same for pieces read backwards.
        self.backward: dict[str, list] = {}
        for piece, score in self.scores.items():
            at, node = self.backward, None
            for c in reversed(piece):
                node = at.setdefault(c, [None, {}])
                at = node[1]
            node[0] = score
        inside = {c for p in self.scores for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        if any(BLANK in p.lstrip(BLANK) for p in self.scores):
            self.parts = re.compile(f"[{alone}]|[^{alone}]+" if alone else "(?s).+")
        else:  # blanks only begin pieces: no piece reaches from another character to a blank
            self.parts = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"(?s){BLANK}*[^{BLANK}]+|{BLANK}+")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.packed: list[bytes] = []
        self.alternatives: dict[tuple[str, int], list] = {}
        #: Per part: score, what the second best path loses, and whether the ids of the best one give the part back.
        self.figures = np.zeros((3, 1 << 12))

    def _tables(self) -> None:
        """The tree of pieces as arrays: codes of characters, and for (node, code) the next node by an open hash table."""
        letters = sorted({c for p in self.scores for c in p})
        self.code = np.zeros(0x110000, dtype=np.int64)
        for k, c in enumerate(letters, 1):
            self.code[ord(c)] = k
        number, edges, scores, ids = {"": 0}, [], [np.nan], [0]
        for piece in sorted(self.scores):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in number:
                    number[piece[:k]] = len(number)
                    edges.append((number[piece[: k - 1]], self.code[ord(piece[k - 1])], number[piece[:k]]))
                    scores.append(np.nan)
                    ids.append(0)
            scores[number[piece]], ids[number[piece]] = self.scores[piece], self.ids[piece]
        self.node_score, self.node_id = np.array(scores), np.array(ids, dtype=np.uint32)
        self.letters = len(letters) + 1
        table = np.array(edges, dtype=np.int64)
        keys = table[:, 0] * self.letters + table[:, 1]
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at = np.where(self.slot_key[at] != -1, (at + 1) & (len(self.slot_key) - 1), at)
            free = self.slot_key[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), dtype=bool)
            wins[first] = True
            wins &= free
            self.slot_key[at[wins]], self.slot_node[at[wins]] = keys[todo[wins]], table[todo[wins], 2]
            todo, at = todo[~wins], at[~wins]
        root = np.arange(self.letters)
        #: Codes of the characters that are pieces themselves.
        self.single = ~np.isnan(self.node_score[self._next(np.zeros_like(root), root)])
        self.single[0] = False

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the code leads to from each node; 0 for nothing."""
        key = node * self.letters + code
        at = self._slot(key)
        out = np.where(self.slot_key[at] == key, self.slot_node[at], 0)
        open_ = np.flatnonzero((self.slot_key[at] != key) & (self.slot_key[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            have = self.slot_key[at[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.slot_node[at[open_[hit]]]
            open_ = open_[~hit & (have != -1)]
        return out

    def id_bytes(self, piece: str) -> bytes:
        """Packed ids of a piece, or of the bytes of an unknown character."""
        have = self.packed_ids.get(piece)
        if have is None:
            have = self.packed_ids[piece] = b"".join(self.byte.get(b, self.unknown_id).to_bytes(4, "little") for b in piece.encode())
        return have

    def forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """For each position the best and second best score from the beginning, and where the best one's edge begins."""
        n, low = len(s), float("-inf")
        best, second, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            x, y, j = best[i], second[i], i + 1
            node = self.tree.get(s[i])
            w = None if node is None else node[0]
            if w is None:
                w = self.unknown
            while True:
                if w is not None:
                    v = x + w
                    if v > best[j]:
                        second[j] = best[j] if best[j] > y + w else y + w
                        best[j], back[j] = v, i
                    elif v > second[j]:
                        second[j] = v
                if j == n or node is None:
                    break
                node = node[1].get(s[j])
                if node is None:
                    break
                w = node[0]
                j += 1
        return best, second, back

    def edges_into(self, s: str, at: int) -> list[tuple[int, float]]:
        """Where the edges that end at a position begin, and their scores."""
        node = self.backward.get(s[at - 1])
        start = at - 1
        out = [(start, self.unknown if node is None or node[0] is None else node[0])]
        while node is not None and start:
            start -= 1
            node = node[1].get(s[start])
            if node is not None and node[0] is not None:
                out.append((start, node[0]))
        return out

    def paths(self, s: str, most: int | None = None) -> Iterator[tuple[float, list[str]]]:
        """(score, pieces) of the ``most`` best segmentations of a part (else all), best first.

        A backward A* on the forward scores.  Of equal scores what is nearer to the beginning comes first, so that ties
        don't widen the search.
        """
        best, _, _ = self.forward(s)
        order = itertools.count()
        heap: list[tuple] = [(-best[len(s)], len(s), 0, 0.0, None)]
        while heap:
            _, at, _, behind, rest = heapq.heappop(heap)
            if at == 0:
                pieces = []
                while rest:
                    pieces.append(s[rest[0] : rest[1]])
                    rest = rest[2]
                yield behind, pieces
                if most is not None:
                    most -= 1
                    if not most:
                        return
                continue
            for start, w in self.edges_into(s, at):
                heapq.heappush(heap, (-(best[start] + w + behind), start, next(order), behind + w, (start, at, rest)))
            if most is not None and len(heap) > 4 * most:
                heap = heapq.nsmallest(most, heap)

    def _learn_one(self, s: str) -> tuple[float, float, bytes]:
        best, second, back = self.forward(s)
        packed, at, have = [], len(s), self.packed_ids
        while at:
            start = back[at]
            piece = s[start:at]
            packed.append(have[piece] if piece in have else self.id_bytes(piece))
            at = start
        return best[-1], best[-1] - second[-1], b"".join(reversed(packed))

    def learn(self, parts: list[str]) -> None:
        """Best segmentations of new, distinct parts, most of them all at once."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        code = self.code[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        ends = np.cumsum(size)
        known = np.concatenate(([0], np.cumsum(self.single[code])))
        whole = (size <= LONG) & (known[ends] - known[ends - size] == size)
        first = len(self.packed)
        while self.figures.shape[1] < first + len(parts):
            self.figures = np.concatenate((self.figures, np.zeros_like(self.figures)), axis=1)
        scores, losses = np.empty(len(parts)), np.empty(len(parts))
        packed: list[bytes] = [b""] * len(parts)
        for k in np.flatnonzero(~whole).tolist():
            scores[k], losses[k], packed[k] = self._learn_one(parts[k])
        use = np.flatnonzero(whole)
        if len(use):
            scores[use], losses[use], ids, counts = self._forward_all(code, ends[use] - size[use], size[use])
            raw, at = ids.tobytes(), 0
            for k, n in zip(use.tolist(), (4 * counts).tolist(), strict=True):
                packed[k] = raw[at : at + n]
                at += n
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.packed += packed
        self.figures[:, first : first + len(parts)] = scores, losses, self._give_back(parts, packed)

    def _give_back(self, parts: list[str], packed: list[bytes]) -> np.ndarray:
        """Whether the ids of each part stand for its bytes."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        made = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        sizes = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
        stops = sizes[ends]
        starts = np.concatenate(([0], stops[:-1]))
        wanted = [p.encode("utf-8", "surrogatepass") for p in parts]
        if made == b"".join(wanted) and (stops - starts == np.fromiter(map(len, wanted), np.int64, len(wanted))).all():
            return np.ones(len(parts), dtype=bool)
        return np.array([made[a:b] == w for a, b, w in zip(starts.tolist(), stops.tolist(), wanted, strict=True)])

    def _forward_all(self, code: np.ndarray, starts: np.ndarray, size: np.ndarray):
        """Scores, losses, ids and their number for parts of single known characters: the forward pass, position by
        position, for all of them."""
        # Each part gets one place more than it has characters.
        own = np.cumsum(size + 1) - (size + 1)
        total = int((size + 1).sum())
        part = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        letters, place, left = code[starts[part] + inside], own[part] + inside, size[part] - inside
        # All edges: (offset of the beginning in its part, length) of pieces, depth by depth.
        node, alive = np.zeros(len(part), dtype=np.int64), np.arange(len(part))
        edges: list[list[tuple]] = [[] for _ in range(int(size.max()))]
        depth = 0
        while len(alive):
            node = self._next(node, letters[alive + depth]).astype(np.int64)
            go = node > 0
            alive, node = alive[go], node[go]
            score = self.node_score[node]
            some = np.flatnonzero(~np.isnan(score))
            order = some[np.argsort(inside[alive[some]], kind="stable")]
            offsets, begins = np.unique(inside[alive[order]], return_index=True)
            for o, a, b in zip(offsets.tolist(), begins.tolist(), np.append(begins, len(order))[1:].tolist(), strict=True):
                k = order[a:b]
                edges[o].append((place[alive[k]], depth + 1, score[k], node[k]))
            depth += 1
            go = left[alive] > depth
            alive, node = alive[go], node[go]
        low = -np.inf
        best, second = np.full(total, low), np.full(total, low)
        back, via = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        best[own] = 0.0
        for groups in edges:
            for at, length, w, n in groups:
                to = at + length
                v, other, had = best[at] + w, second[at] + w, best[to]
                better = v > had
                second[to] = np.maximum(np.maximum(second[to], other), np.minimum(v, had))
                t = to[better]
                best[t], back[t], via[t] = v[better], at[better], n[better]
        last = own + size
        rows, at, found = np.arange(len(size)), last.copy(), []
        while len(rows):
            found.append((rows, self.node_id[via[at]]))
            at = back[at]
            go = at > own[rows]
            rows, at = rows[go], at[go]
        which = np.concatenate([r for r, _ in found])
        step = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
        ids = np.concatenate([i for _, i in found])
        ids = ids[np.lexsort((-step, which))].astype("<u4")
        return best[last], best[last] - second[last], ids, np.bincount(which, minlength=len(size))

    def best_of(self, s: str, n: int) -> list[tuple[float, bytes, bool]]:
        """The n best (loss against the best, packed ids, whether these give the part back) of a part."""
        got = self.alternatives.get((s, n))
        if got is None:
            got, first = [], None
            for score, pieces in self.paths(s, n):
                first = score if first is None else first
                ids = b"".join([self.id_bytes(p) for p in pieces])
                got.append((first - score, ids, self.raw(ids) == s.encode("utf-8", "surrogatepass")))
            self.alternatives[s, n] = got
        return got

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The parts of texts, of which the new ones are learnt together."""
        if len(self.packed) > REMEMBERED or len(self.alternatives) > REMEMBERED:
            self.forget()
        parts = [self.parts.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*parts).difference(self.number)
        if new:
            self.learn(list(new))
        return parts

    def checked(self, parts: list[str], n: int = BEST) -> tuple[list[tuple[float, bytes]], bool]:
        """The n best (score, ids as packed little-endian 32-bit numbers) of a text's parts, best first; and whether
        the ids of all of them give the text back (part by part, as no character is shared by parts)."""
        if not parts:
            return [(0.0, b"")], True
        numbers = list(map(self.number.__getitem__, parts))
        packed = list(map(self.packed.__getitem__, numbers))
        places = np.array(numbers)
        losses = self.figures[1, places]
        best, whole = float(self.figures[0, places].sum()), bool(self.figures[2, places].all())
        # (total loss, {part: its ids}) of the best combinations so far; parts in the order of what they lose.
        chosen: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        few = np.argpartition(losses, n - 2)[: n - 1] if 1 < n <= len(losses) else np.arange(len(losses) if n > 1 else 0)
        for at in few[np.lexsort((few, losses[few]))].tolist():
            if losses[at] == np.inf:
                break
            options = self.best_of(parts[at], n)
            whole &= all(ok for _, _, ok in options)
            mixed = [(a + b, {**have, at: ids} if k else have) for a, have in chosen for k, (b, ids, _) in enumerate(options)]
            chosen = heapq.nsmallest(n, mixed, key=lambda c: c[0])
        # What all of them share is put together once.
        changed = sorted(set().union(*(have for _, have in chosen)))
        between = [b"".join(packed[a + 1 : b]) for a, b in zip([-1, *changed], [*changed, len(packed)], strict=True)]
        out = []
        for lost, have in chosen:
            row = [between[0]]
            for k, after in zip(changed, between[1:], strict=True):
                row += (have.get(k, packed[k]), after)
            out.append((best - lost, b"".join(row)))
        return out, whole

    def segment(self, text: str, n: int = BEST) -> list[tuple[float, bytes]]:
        """The n best of a text; an empty one has one, empty."""
        return self.checked(self.split([text])[0], n)[0]

    def raw(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids) -> str:
        """The text of a list of ids: bytes of byte pieces are read as UTF-8; one leading blank is taken off."""
        try:
            out = "".join(map(self.whole.__getitem__, ids)).replace(BLANK, " ")
        except KeyError:  # bytes of longer characters, which only together make sense
            raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids)
            out = raw.decode("utf-8", "replace").replace(BLANK, " ")
        return out[1:] if out.startswith(" ") else out


_loaded: dict[bytes, Lattice] = {}


def lattice(model: bytes) -> Lattice:
    """One lattice for each model and process."""
    key = hashlib.blake2b(model, digest_size=16).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Lattice(model)
    return _loaded[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """doc_id and segmentations (score, ids), best first, of each text; ``model`` is the path of a model file.

    A null or empty text has one segmentation without ids.  There are fewer than ``best`` where a text has no more.
    """
    shared = _model(docs, model)

    def run(cols: dict, m: Lattice) -> dict:
        return {"doc_id": cols["doc_id"], "segmentations": [[{"score": s, "ids": np.frombuffer(b, "<u4").astype(np.int32)} for s, b in m.checked(p, best)[0]] for p in m.split(cols["text"])]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, segmentations array<struct<score: double, ids: array<int>>>", lambda: lattice(shared.value))


def merged(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each text as the model itself encodes it, by the library; a null text counts as empty."""
    shared = _model(docs, model)

    def setup():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=shared.value)

    def run(cols: dict, m) -> dict:
        return {"doc_id": cols["doc_id"], "ids": [m.encode(t or "") for t in cols["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>", setup)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of the integer lists in column ``ids``; a null list gives a null text."""
    shared = _model(encoded, model)

    def run(cols: dict, m: Lattice) -> dict:
        return {"doc_id": cols["doc_id"], "text": [None if x is None else m.decode(x) for x in cols["ids"]]}

    return map_columns(encoded.selectExpr("doc_id", f"`{ids}` as ids"), run, "doc_id long, text string", lambda: lattice(shared.value))


def digest(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """Per row: n_best, and of each of the best segmentations its score, number of ids and checksum of the ids.

    decoded tells whether the ids of all of them give the text back (blanks written as U+2581 come back as blanks).
    A null text counts as empty; null and repeated ids and repeated rows are rows like any other; an empty table gives
    no rows; other columns are ignored.
    """
    shared = _model(docs, model)

    def run(cols: dict, m: Lattice) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_best", "scores", "n_ids", "ids_crc32", "decoded")}
        for key, parts in zip(cols["doc_id"], m.split(cols["text"]), strict=True):
            got, whole = m.checked(parts, best)
            row = (key, len(got), [s for s, _ in got], [len(b) // 4 for _, b in got], [zlib.crc32(b) for _, b in got], whole)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    schema = "doc_id long, n_best int, scores array<double>, n_ids array<long>, ids_crc32 array<long>, decoded boolean"
    return map_columns(docs.select("doc_id", "text"), run, schema, lambda: lattice(shared.value))
