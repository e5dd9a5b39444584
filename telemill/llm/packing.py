"""Sequence packing by minimum bin slack.

Documents become token ids with a closing id; only documents longer than a sequence are cut.  Which lengths share a
sequence depends on nothing but the histogram of piece lengths, which has at most ``capacity`` rows whatever the
corpus: the plan is made from it on the driver.  Per sequence, the longest piece left is fixed and a subset-sum over
the lengths left, as a bitset in one big integer, finds the fullest feasible combination.  As long as its lengths
last, that combination stays the fullest, so it is removed as many times as it fits at once, which leaves a few
thousand searches for any number of sequences.  Pieces get their place from their global rank in the order of length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns
from .bpe import PATTERN, byte_letters, check_settings
from .sharding import number_rows
from .workspace import materialise

CAPACITY, CLOSING_ID = 2048, 0


def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32) under the text of a ``tokenizers`` byte-level BPE file.

    Where ids are in the order of merges and all settings are those of that file, ranks alone define the merges, and the
    ids come from tiktoken, which is several times faster and gives the same ids; texts it can't take, such that hold the
    name of an added token, and files with any other setting, go through ``tokenizers`` itself, as it is.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(vocabulary)

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    file = json.loads(vocabulary)
    model, added = file["model"], [t["content"] for t in file.get("added_tokens", [])]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    try:
        check_settings(file)
    except ValueError:
        return plain
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return plain
    import tiktoken

    letters = byte_letters()
    ranks = {bytes(letters[c] for c in word): rank for word, rank in model["vocab"].items() if rank < 256 + len(merges)}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def quick(text: str) -> np.ndarray:
        if any(name in text for name in added):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # its matcher gives up on some very long runs: a panic, which is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, (ValueError, RuntimeError)):
                raise
            return plain(text)

    return quick


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; ``tokenizer`` is the path of a vocabulary file.

    A null text counts as empty, which has the closing id alone.  A document of more than ``capacity`` ids is cut into
    pieces of ``capacity``, of which the first may be shorter.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(cols: dict, encode) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for key, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = np.append(encode(text or ""), np.uint32(closing_id)).astype("<u4")
            stop = len(ids) % capacity or capacity
            start = piece = 0
            while start < len(ids):
                part = ids[start:stop]
                for k, v in zip(out, (key, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    out[k].append(v)
                start, stop, piece = stop, stop + capacity, piece + 1
        return out

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", lambda: encoder(vocabulary.value))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, each used at most as often as ``counts`` says, whose sum is the largest that ``room`` holds.

    Bit s of ``reach`` tells that the sum s can be made; each round shifts it by one bundle of equal lengths (powers of
    two make every multiplicity).  Longer lengths come first, so short ones, which fit anywhere, are used last.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


@dataclass
class Plan:
    """Per run of ranks in the order of length: its first rank, first sequence, and offset in each sequence."""

    first_rank: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = {k: v for k, v in histogram.items() if v}
    runs: dict[int, list[tuple[int, int, int]]] = {k: [] for k in counts}
    sequences = 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        times = min(counts[x] // n for x, n in used.items())
        offset = 0
        for x in chosen:
            runs[x].append((times, sequences, offset))
            offset += x
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequences += times
    rank, rows = 0, []
    for x in sorted(runs):
        for times, sequence, offset in runs[x]:
            rows.append((rank, sequence, offset))
            rank += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], sequences)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Every piece of every document with its sequence_id (from 0) and offset; sequences have no gaps between pieces.

    Null ids, repeated ids and repeated rows are packed as rows of their own; an empty table gives an empty result;
    other columns are ignored.
    """
    pieces = materialise(tokenise(docs, tokenizer, capacity, closing_id), "pieces")
    ranked, _ = number_rows(pieces, ["length", "doc_id", "piece", "ids_crc32"], "pieces-ranked", "rank")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = plan(histogram, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        at = np.searchsorted(p.first_rank, r, side="right") - 1
        return pd.DataFrame({"sequence_id": p.first_sequence[at] + r - p.first_rank[at], "offset": p.offset[at]})

    return ranked.withColumn("__at", place("rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")
