"""Fixed-size vectors summed over all rows: tasks sum their rows, groups of at most ``FAN`` tasks' parts are merged level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that one group merges at most.
FAN = 64
_PART = pa.schema([("chunk", pa.int32()), ("lot", pa.int64()), ("rows", pa.binary()), ("vector", pa.binary()), ("n", pa.int64())])
_DDL = "chunk int, lot long, rows binary, vector binary, n long"


def _part(chunk: int, lot: int, piece: np.ndarray, n: int) -> pa.RecordBatch:
    """The rows of a piece that are not zero."""
    some = np.flatnonzero(piece.any(axis=tuple(range(1, piece.ndim)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((chunk, lot, some.tobytes(), piece[some].tobytes(), n), _PART)], schema=_PART)


def partial_sums(rows: DataFrame, add: Callable[[np.ndarray, list], None], shape: tuple[int, ...], dtype: type, chunks: int = 8) -> DataFrame:
    """The tasks' sums in ``chunks`` pieces, with the task's number as their lot."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, dtype), 0
        for b in batches:
            for i in range(0, len(b), 256):
                values = b.column(0).slice(i, 256).to_pylist()
                add(total, values)
                n += len(values)
        if n:
            for chunk, piece in enumerate(np.array_split(total, chunks)):
                yield _part(chunk, TaskContext.get().partitionId(), piece, n)

    return rows.mapInArrow(partial, _DDL)


def merged(parts: DataFrame, shape: tuple[int, ...], dtype: type, chunks: int = 8, fan: int | None = FAN) -> DataFrame:
    """One part for each chunk and ``fan`` lots that follow each other; without ``fan`` one for each chunk."""
    sizes = [len(p) for p in np.array_split(np.empty(shape[0], bool), chunks)]

    def merge(table: pa.Table) -> pa.Table:
        chunk, n = table["chunk"][0].as_py(), 0
        total = np.zeros((sizes[chunk], *shape[1:]), dtype)
        for some, vector, m in zip(*(table[c].to_pylist() for c in ("rows", "vector", "n"))):
            total[np.frombuffer(some, np.int32)] += np.frombuffer(vector, dtype).reshape(-1, *shape[1:])
            n += m
        return pa.Table.from_batches([_part(chunk, table["lot"][0].as_py() // (fan or 1), total, n)])

    return parts.groupBy("chunk", *([F.expr(f"lot div {fan}")] if fan else [])).applyInArrow(merge, _DDL)


def summed(rows: DataFrame, add: Callable[[np.ndarray, list], None], shape: tuple[int, ...], dtype: type, chunks: int = 8) -> tuple[np.ndarray, int]:
    """(vector, rows): ``add(total, values)`` adds the values of the one column of ``rows`` to a task's total, batch by batch.

    There are as many levels as the number of tasks asks for, one for up to ``FAN``. The driver gets one vector.
    """
    parts, tasks = partial_sums(rows, add, shape, dtype, chunks), rows.rdd.getNumPartitions()
    while tasks > FAN:
        parts, tasks = merged(parts, shape, dtype, chunks), -(-tasks // FAN)
    parts = merged(parts, shape, dtype, chunks, None)
    out, n = np.zeros(shape, dtype), 0
    starts = np.concatenate([[0], np.cumsum([len(p) for p in np.array_split(np.empty(shape[0], bool), chunks)])])
    for r in parts.collect():
        out[starts[r["chunk"]] + np.frombuffer(bytes(r["rows"]), np.int32)] = np.frombuffer(bytes(r["vector"]), dtype).reshape(-1, *shape[1:])
        n = r["n"]
    return out, n
