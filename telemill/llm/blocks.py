"""Comparing the members of groups, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def map_groups(df: DataFrame, by: list[str], fn: Callable[[tuple, dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each group: of its key and a dict of lists (list columns as numpy arrays).

    The caller bounds the size of groups.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    others = [c for c in df.columns if c not in by]

    def values(column: pa.Array) -> list:
        if pa.types.is_list(column.type):
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            return [flat[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
        return column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            columns = dict(zip(others, map(list, zip(*held, strict=True)), strict=True))
            held.clear()
            if found := fn(last, columns):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            groups = zip(*(batch[c].to_pylist() for c in by), strict=True)
            rows = zip(*(values(batch[c]) for c in others), strict=True)
            for group, row in zip(groups, rows, strict=True):
                if last is not None and last != group:
                    yield from flush()
                last = group
                held.append(row)
        if held:
            yield from flush()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


class Connected:
    """Which members of a group are connected so far, and the links that did it."""

    def __init__(self, node: np.ndarray):
        self.node, self.label, self.links = node, np.arange(len(node)), []

    def already(self, x: int, y: int) -> bool:
        return self.label[x] == self.label[y]

    def join(self, x: int, y: int) -> None:
        if self.label[x] != self.label[y]:
            self.links.append((int(self.node[x]), int(self.node[y])))
            self.label[self.label == self.label[y]] = self.label[x]
