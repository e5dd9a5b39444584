"""Row functions over Arrow batches with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of input that a row function gets at once; a longer value comes alone.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about SLICE_BYTES, so that long values never meet in memory by the thousand."""
    n = batch.num_rows
    step = max(1, min(SLICE_ROWS, int(n * SLICE_BYTES / max(1, batch.nbytes))))
    start = 0
    while start < n:
        part = batch.slice(start, step)
        while part.num_rows > 1 and part.get_total_buffer_size() > 0 and _bytes(part) > 2 * SLICE_BYTES:
            part = part.slice(0, (part.num_rows + 1) // 2)
        yield part
        start += part.num_rows


def _bytes(part: pa.RecordBatch) -> int:
    return part.nbytes


def map_slices(df: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str | StructType, setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with ``fn(slice)`` from record batch to record batch; columns that pass are never turned into objects."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch):
                out = fn(part, *state)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, kind)


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str | StructType, setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with ``fn(columns)`` from a dict of Python lists to a dict of lists (of any equal length).

    ``setup`` runs once a task; its result is then passed as the second argument.  Rows don't depend on one another.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch):
                out = fn(part.to_pydict(), *state)
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
