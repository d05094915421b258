"""Small helpers for mapInArrow operators: batches in, batches of a Spark schema out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Bytes of a slice of a batch that is worked on at once; vectorised work takes a few dozen times as much memory.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut so that each part holds about SLICE_BYTES, or one row."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_arrow(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``start`` runs once in each task and returns the function that turns a batch into columns of ``schema``."""
    kind: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, work = to_arrow_schema(kind), start()
        for whole in batches:
            for batch in slices(whole):
                made = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else made[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def rows_of(matrix: np.ndarray) -> pa.Array:
    """A binary column with one row of the matrix in each value."""
    width = matrix.shape[1] * matrix.itemsize
    at = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(matrix))])
