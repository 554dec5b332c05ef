"""Exact vector search over stored vectors: matrix products in tasks, and the best rows of each task.

Vectors are stored once as bytes of equal length beside their norm and the columns that searches filter by. A task takes the bytes of
a batch as one matrix, without a copy, multiplies it with the query and hands over its best rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.predicates import message_filter


def store_vectors(rows: DataFrame, path: str, *, vector: str = "embedding") -> None:
    """Writes ``rows`` with ``packed`` (the vector's doubles as bytes) and ``norm`` in place of the vector.

    Rows with a null vector, a null element or a vector of length 0 are left out, as no search finds them.
    """
    kept = [c for c in rows.columns if c != vector]
    numbers = F.transform(vector, lambda x: x.cast("double"))
    able = rows.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(*kept, numbers.alias("v"))
    schema = able.select(*kept).schema.add("packed", "binary").add("norm", "double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.array(x, float) for x in b.column(len(kept)).to_pylist()]
            norms = np.array([np.sqrt(x @ x) for x in lists])
            packed = pa.array([x.tobytes() for x in lists], pa.binary())
            made = pa.RecordBatch.from_arrays([*b.columns[: len(kept)], packed, pa.array(norms, pa.float64())], names=[*kept, "packed", "norm"])
            yield made.filter(pa.array(norms > 0, pa.bool_()))

    able.mapInArrow(pack, schema).write.parquet(path)


def stored_search(spark: SparkSession, path: str, vector: list[float], *, limit: int = 20, offset: int = 0, key: str = "id", **filters: Any) -> DataFrame:
    """key, similarity of the nearest rows that pass the message filters; ties by key. Rows of another dimension are errors.

    ``ValueError`` for a query without length.
    """
    query = np.array(vector, float)
    size = float(np.sqrt(query @ query))
    if not size:
        raise ValueError("the query vector has no length")
    unit, most = query / size, limit + offset
    rows = spark.read.parquet(path).filter(message_filter(**filters)).select(F.col(key).cast("long").alias("key"), "packed", "norm")
    schema = pa.schema([("key", pa.int64()), ("similarity", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores = np.empty(0, np.int64), np.empty(0)
        for b in batches:
            if not len(b):
                continue
            packed = b.column(1)
            at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            matrix = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(float).reshape(len(b), -1)
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            scores = np.concatenate([scores, matrix @ unit / b.column(2).to_numpy()])
            order = np.lexsort((keys, -scores))[:most]
            keys, scores = keys[order], scores[order]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(scores)], schema=schema)

    found = rows.mapInArrow(best, "key long, similarity double")
    return found.orderBy(F.desc("similarity"), "key").offset(offset).limit(limit).select(F.col("key").alias(key), "similarity")
