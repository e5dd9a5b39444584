"""Byte-level BPE without a merge loop: an exact encoder that goes back where a longest match was wrong, and a decoder.

A sequence of tokens is what merging by rank gives exactly if no merge crosses the border of two neighbours.  So the
encoder takes the longest token at its place, which an Aho-Corasick automaton over the reversed text has told for all
places in one pass, and asks a table of pairs whether it may follow the one before.  If not, it tries the token's next
shorter beginning, and if none is left it takes the last token back and marks the place as a dead end.  Each place is
left for good at most once, so the time is linear in the text whatever its letters are.  Decoding gathers bytes from one
table of all tokens by offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .arrow import map_columns

#: Fixed value: how the file's pre-tokenizer (byte level, with its own expression) parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts and pairs that a worker remembers, characters of a part that it remembers, and of a text that it parts at once.
MOST_PARTS, MOST_PAIRS, PART, BLOCK = 1 << 18, 1 << 20, 48, 1 << 20
#: Ids that are decoded at once.
IDS = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: themselves if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_settings(file: dict) -> None:
    """Raise ValueError unless the file's settings are those that this module knows to follow."""
    wanted = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    model, before = file["model"], file.get("pre_tokenizer") or {}
    odd = [k for k, v in wanted.items() if model.get(k, v) != v and (model.get(k) or v)]
    if file.get("normalizer"):
        odd.append("normalizer")
    if (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True):
        odd.append("pre_tokenizer")
    if (file.get("decoder") or {}).get("type") != "ByteLevel":
        odd.append("decoder")
    odd += [f"added token {t['content']}" for t in file.get("added_tokens") or [] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"the vocabulary file has settings that aren't supported: {', '.join(odd)}")


class _Parts(dict):
    """The ids of parts, as bytes; a bounded number of short ones is remembered."""

    def __init__(self, tokens: Callable[[bytes], list[int]]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, part: str) -> bytes:
        found = np.array(self.tokens(part.encode()), dtype="<u4").tobytes()
        if len(part) <= PART:
            if len(self) >= MOST_PARTS:
                self.clear()
            self[part] = found
        return found


@lru_cache(maxsize=1)
def _doubtful() -> tuple[re.Pattern, re.Pattern]:
    """Characters that libraries of different Unicode versions may class as letter, number or neither; all from their first on."""
    kind = lambda k: k[0] if k[0] in "LN" else "o"
    letters, numbers = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    ranges: list[list[int]] = []
    for c in range(0x110000):
        ch, k = chr(c), unicodedata.category(chr(c))
        if k == "Cn" or (c > 127 and kind(k) != ("L" if letters.match(ch) else "N" if numbers.match(ch) else "o")):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    within = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")
    return within, re.compile(f"[{chr(ranges[0][0])}-{chr(0x10FFFF)}]")


class Coder:
    """Encoder and decoder of a ``tokenizers`` byte-level BPE file, given as its text.

    ``encode`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, the name of an added token in a
    text being that token, and ``decode`` the text of ``Tokenizer.decode(ids, skip_special_tokens=False)``.  A file with
    other settings, with merges whose parts are made later, or with several merges for one token is refused.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        check_settings(file)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        raw = {word: bytes(letters[c] for c in word) for word in vocab if word not in added}
        of_bytes = {raw[word]: k for word, k in vocab.items() if word not in added}
        if missing := [b for b in range(256) if bytes([b]) not in of_bytes]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        size = max([*vocab.values(), *added.values()]) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= rank or any(len(raw[w]) > 1 and self.rank[vocab[w]] < 0 for w in (a, b)):
                raise ValueError(f"merge {rank} is not one of the supported order")
            self.left[z], self.right[z], self.rank[z] = x, y, rank
            self.merges[x, y] = rank
        own = self._own(of_bytes)
        self.length = [0] * size
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for word, k in of_bytes.items():
            if own[k]:
                self.length[k] = len(word)
                self.shorter[k] = next((of_bytes[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in of_bytes and own[of_bytes[word[:n]]]), -1)
                self.automaton.add_word(word.decode("latin-1")[::-1], k)
        self.automaton.make_automaton()
        spelled = [b""] * size
        for word, k in of_bytes.items():
            spelled[k] = word
        for word, k in added.items():
            spelled[k] = word.encode()
        self.table = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in spelled]))).astype(np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts = _Parts(self.tokens)
        self.split = regex.compile(PATTERN).findall
        self.border = regex.compile(r"(?<=\S)\s")
        self.added = {name: np.array([k], dtype="<u4").tobytes() for name, k in added.items()}
        self.names = re.compile("(" + "|".join(re.escape(n) for n in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.doubtful, self.beyond = _doubtful()
        self.library = Tokenizer.from_str(vocabulary).pre_tokenizer

    def _own(self, of_bytes: dict[bytes, int]) -> list[bool]:
        """Which tokens their own bytes are encoded as; others can never stand in a result."""
        own = [False] * len(self.rank)
        for k in sorted(of_bytes.values(), key=lambda k: self.rank[k]):
            a, b, rank = self.left[k], self.right[k], self.rank[k]
            own[k] = rank < 0 and a < 0 or rank >= 0 and own[a] and own[b] and not self._crossed(a, b, rank)
        for word, k in of_bytes.items():
            own[k] = own[k] and (len(word) == 1 or self.rank[k] >= 0)
        return own

    def _crossed(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge of a rank below ``limit`` joins the end of token a to the beginning of token b.

        What stands at the border is, at any time, a token on the right edge of a's tree of merges and one on the left
        edge of b's.  Both edges are gone down in the order of time: the later of the two gives way to its part, which
        lives until it was merged.  Of equal merges the one further left is done first.
        """
        a_ends = b_ends = limit
        while True:
            m = self.merges.get((a, b), limit)
            if m < a_ends and m <= b_ends and m < limit:
                return True
            if self.rank[a] < 0 and self.rank[b] < 0:
                return False
            if self.rank[a] >= self.rank[b]:
                a_ends, a = self.rank[a], self.right[a]
            else:
                b_ends, b = self.rank[b], self.left[b]

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = not self._crossed(a, b, 1 << 62)
        return known

    def tokens(self, part: bytes) -> list[int]:
        """The ids of one part of a text, which no merge leaves."""
        n = len(part)
        longest = [-1] * n
        for end, k in self.automaton.iter(part.decode("latin-1")[::-1]):
            if longest[n - 1 - end] < 0:  # the longest is told first
                longest[n - 1 - end] = k
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + self.length[token]
            if not dead[end] and (not out or self._may_follow(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]

    def _blocks(self, text: str) -> Iterator[str]:
        """A text in pieces that the expression parts as it does the whole: a space after none is never within a part."""
        start = 0
        while len(text) - start > BLOCK:
            found = self.border.search(text, start + BLOCK)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32)."""
        out = []
        for k, piece in enumerate(self.names.split(text) if self.names else [text]):
            if k % 2:
                out.append(self.added[piece])
                continue
            for block in self._blocks(piece) if piece else ():
                if self.beyond.search(block) and self.doubtful.search(block):
                    parts = [block[a:b] for _, (a, b) in self.library.pre_tokenize_str(block)]
                else:
                    parts = self.split(block)
                out += map(self.parts.__getitem__, parts)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = []
        for at in range(0, len(ids), IDS):
            some = ids[at : at + IDS].astype(np.int64)
            begins = self.offsets[some]
            sizes = self.offsets[some + 1] - begins
            ends = np.cumsum(sizes)
            raw.append(self.table[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(raw).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def coder(vocabulary: str) -> Coder:
    """The coder of a vocabulary, which a worker keeps from task to task."""
    return Coder(vocabulary)


def _shared(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of long) of every text; a null text counts as empty, and has none.

    Rows are taken one by one, so null or repeated ids and repeated rows are rows of their own, an empty table gives an
    empty result, other columns are ignored, and one very long text is parted and encoded in blocks.
    """
    vocabulary = _shared(docs, tokenizer)

    def run(cols: dict, c: Coder) -> dict:
        return {"doc_id": cols["doc_id"], "ids": [c.encode(t or "").astype(np.int64) for t in cols["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>", lambda: coder(vocabulary.value))


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""
    vocabulary = _shared(coded, tokenizer)

    def run(cols: dict, c: Coder) -> dict:
        return {"doc_id": cols["doc_id"], "text": [None if x is None else c.decode(np.array(x, dtype=np.int64)) for x in cols["ids"]]}

    return map_columns(coded.select("doc_id", "ids"), run, "doc_id long, text string", lambda: coder(vocabulary.value))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and same (whether the decoded text is the text) of every text.

    Encodes and decodes in one pass, so that ids needn't travel; rows as in ``encode``.
    """
    vocabulary = _shared(docs, tokenizer)

    def run(cols: dict, c: Coder) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same")}
        for key, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = c.encode(text or "")
            back = c.decode(ids)
            row = (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or ""))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean", lambda: coder(vocabulary.value))
