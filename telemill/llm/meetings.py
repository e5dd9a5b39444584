"""Finding what shares a key, by one shuffle of packed numbers.

Python makes (key, value) pairs of 64 bits each and packs them by the bucket of their key, so that a row carries
thousands of pairs.  Each bucket then comes together in one task, is sorted, and only keys that occur more than once
are looked at.  As the number of buckets grows with the number of pairs, a bucket is of bounded size but for what one
single key holds, which the callers bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .arrow import slices

#: Pairs that a bucket has on average, and that are packed at once.
BUCKET, PACK = 1 << 16, 1 << 17

Pairs = tuple[np.ndarray, np.ndarray]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of well-mixed keys, by their upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _packs(pairs: list[Pairs], buckets: int, arrow: pa.Schema) -> pa.RecordBatch:
    keys, values = (np.concatenate(x) for x in zip(*pairs, strict=True))
    where = bucket_of(keys, buckets)
    order = np.argsort(where, kind="stable")
    both = np.stack((keys[order], values[order]), axis=1)
    places, begins = np.unique(where[order], return_index=True)
    stops = np.append(begins[1:], len(order))
    data = [both[a:b].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(data, pa.binary())], schema=arrow)


def shared_keys(
    df: DataFrame,
    pairs_of: Callable[[pa.RecordBatch], Pairs],
    pairs: int,
    combine: Callable[[np.ndarray, np.ndarray], Pairs],
    found: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    schema: str,
) -> DataFrame:
    """Rows that ``found`` makes of the pairs whose key occurs more than once.

    ``pairs_of`` makes pairs (two uint64 arrays) of a slice of ``df``; ``combine`` may lessen some tens of thousands of
    them before they are shuffled; ``found`` gets, sorted by key, all pairs of a bucket with a repeated key.  ``pairs``
    is about how many there are.
    """
    buckets = max(1, min(-(-pairs // BUCKET), (1 << 31) - 1))
    packed = to_arrow_schema(_parse_datatype_string("bucket long, data binary"))
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(pairs_of(part))
                n += len(held[-1][0])
                if n >= PACK:
                    yield _packs([combine(*map(np.concatenate, zip(*held, strict=True)))], buckets, packed)
                    held, n = [], 0
        if n:
            yield _packs([combine(*map(np.concatenate, zip(*held, strict=True)))], buckets, packed)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            both = np.concatenate(held).reshape(-1, 2)
            held.clear()
            keys, values = both[:, 0], both[:, 1]
            order = np.argsort(keys)
            keys = keys[order]
            same = keys[1:] == keys[:-1]
            use = np.zeros(len(keys), dtype=bool)
            use[1:] = same
            use[:-1] |= same
            if use.any():
                out = found(keys[use], values[order[use]])
                for at in range(0, len(next(iter(out.values()))), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at : at + (1 << 16)], f.type) for f in out_schema], schema=out_schema)

        for batch in batches:
            for where, data in zip(batch["bucket"].to_pylist(), batch["data"], strict=True):
                if last is not None and where != last:
                    yield from flush()
                last = where
                held.append(np.frombuffer(data.as_buffer(), dtype=np.uint64).copy())
        if held:
            yield from flush()

    rows = df.mapInArrow(pack, "bucket long, data binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unpack, schema)


def runs(keys: np.ndarray) -> Pairs:
    """Begins and ends of the runs of equal keys."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(keys))


def distinct(keys: np.ndarray, values: np.ndarray) -> Pairs:
    """Distinct pairs, sorted by key and value."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    return keys[new], values[new]


class Frequent:
    """The most frequent keys of a stream in bounded memory, by the counting of Misra and Gries.

    A key's count is too low by at most ``total / most``, so no key with a larger share is missing.
    """

    def __init__(self, most: int):
        self.most, self.total = most, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._held: list[np.ndarray] = []
        self._n = 0

    def add(self, keys: np.ndarray) -> None:
        self._held.append(keys)
        self._n += len(keys)
        if self._n >= 1 << 18:
            self._merge()

    def _merge(self) -> None:
        self.total += self._n
        keys, number = np.unique(np.concatenate([self.keys, *self._held]), return_inverse=True)
        weights = np.concatenate([self.counts, np.ones(self._n, np.int64)])
        counts = np.bincount(number, weights=weights, minlength=len(keys)).astype(np.int64)
        if len(keys) > self.most:
            counts = counts - np.partition(counts, -self.most - 1)[-self.most - 1]
        self.keys, self.counts, self._held, self._n = keys[counts > 0], counts[counts > 0], [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, int]:
        self._merge()
        return self.keys, self.counts, self.total
