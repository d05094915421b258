"""Adding up bounded numeric vectors over all rows of a table.

Each task keeps one vector of fixed length and emits it compressed, cut into chunks; the chunks are reduced in a
tree, so no step reads more than FAN_IN vectors of one chunk, and only the final vector, whose length is a constant of
the operator, reaches the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilspark.functions.arrow import slices

FAN_IN = 128
_SCHEMA = "salt int, chunk int, data binary"


def pack(part: np.ndarray) -> bytes:
    """A vector in few bytes: where most of it is zero, the gaps between the other values and these; else as it is."""
    at = np.flatnonzero(part)
    if 6 * len(at) >= len(part):
        return b"d" + zlib.compress(part.tobytes(), 1)
    gaps = np.diff(at, prepend=0)
    gaps = gaps.astype(np.min_scalar_type(int(gaps.max()) if len(gaps) else 0))
    places = zlib.compress(gaps.tobytes(), 1)
    return b"s" + struct.pack("<BQQ", gaps.itemsize, len(part), len(places)) + places + zlib.compress(part[at].tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    """The vector of :func:`pack`; it may be written to."""
    if data[:1] == b"d":
        return np.frombuffer(zlib.decompress(data[1:]), dtype).copy()
    width, length, size = struct.unpack_from("<BQQ", data, 1)
    body = data[1 + struct.calcsize("<BQQ") :]
    out = np.zeros(length, dtype)
    out[np.cumsum(np.frombuffer(zlib.decompress(body[:size]), f"u{width}"), dtype=np.int64)] = np.frombuffer(zlib.decompress(body[size:]), dtype)
    return out


def _levels(df: DataFrame) -> int:
    """Steps of the tree before the last one: none for up to FAN_IN tasks. The tasks of a plan with a shuffle are only
    known when it runs, so it gets two, which is enough for FAN_IN ** 3."""
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return 2
    n, levels = run.toRdd().getNumPartitions(), 0
    while n > FAN_IN:
        n, levels = -(-n // FAN_IN), levels + 1
    return levels


def vector_total(df: DataFrame, length: int, dtype: str, add: Callable[[np.ndarray, pa.RecordBatch], None], how: str | Callable[[int], str] = "sum", chunks: int = 16) -> np.ndarray:
    """The total of the tasks' vectors; ``add(vector, batch)`` puts a batch into the task's own vector.

    how: "sum", "cap" for sums that stay at the type's greatest value, "or" for bit fields, or a function that tells it
    of a chunk's number. An empty table gives zeros.
    """
    step = -(-length // chunks)

    def cut(vector: np.ndarray, salt: int) -> pa.RecordBatch:
        parts = [(c, vector[c * step : (c + 1) * step]) for c in range(chunks)]
        parts = [(c, p) for c, p in parts if p.any()]
        return pa.RecordBatch.from_pydict({"salt": pa.array([salt] * len(parts), pa.int32()), "chunk": pa.array([c for c, _ in parts], pa.int32()), "data": pa.array([pack(p) for _, p in parts], pa.binary())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(length, dtype)
        for batch in batches:
            for part in slices(batch):
                add(vector, part)
        yield cut(vector, TaskContext.get().partitionId() // FAN_IN)

    def both(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
        kind = how(chunk) if callable(how) else how
        if kind == "cap":
            return np.minimum(a, np.iinfo(dtype).max - b) + b
        return a + b if kind == "sum" else a | b

    def reduce(table: pa.Table) -> pa.Table:
        total, chunk = None, table["chunk"][0].as_py()
        if table.num_rows == 1:
            return pa.table({"salt": pa.array([table["salt"][0].as_py() // FAN_IN], pa.int32()), "chunk": table["chunk"], "data": table["data"]})
        for data in table["data"]:
            part = unpack(data.as_py(), dtype)
            total = part if total is None else both(total, part, chunk)
        return pa.table({"salt": pa.array([table["salt"][0].as_py() // FAN_IN], pa.int32()), "chunk": table["chunk"][:1], "data": pa.array([pack(total)], pa.binary())})

    parts = df.mapInArrow(task, _SCHEMA)
    for _ in range(_levels(df)):
        parts = parts.groupBy("salt", "chunk").applyInArrow(reduce, _SCHEMA)
    parts = parts.groupBy("chunk").applyInArrow(reduce, _SCHEMA)
    out = np.zeros(length, dtype)
    for row in parts.collect():
        part = unpack(bytes(row.data), dtype)
        out[row.chunk * step : row.chunk * step + len(part)] = part
    return out
