"""Word helpers that run inside Spark's Arrow tasks, one document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

PRIME = 0x9E3779B97F4A7C15


def step(i: int) -> np.uint64:
    """The odd multiplier of the i-th word of a shingle."""
    return np.uint64(pow(PRIME, i + 1, 1 << 64))


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; null has none."""
    return (text or b"").split()


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(words)
    if len(words) < width:
        whole = np.array([len(words)], np.uint64)
        for i in range(len(h)):
            whole = mixed((whole + h[i : i + 1]) * step(i))
        return whole
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += h[i : i + n] * step(i)
    return np.unique(mixed(out))


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task turns few texts at a time into Python objects."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def arrow_map(row: Callable[[bytes | None], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``row(text bytes)`` of the second column gives the values after the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [row(t) for t in binary(batch.column(1))]
            columns = list(zip(*made)) if made else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run
