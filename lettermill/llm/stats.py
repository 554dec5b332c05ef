"""Statistics of whole texts, one Arrow pass: the evidence of the quality rules and of the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.words import arrow_map, hashed, mixed, split_words, step

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_exclaims", "n_pipes")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
DDL = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"


def repeated_words(h: np.ndarray, width: int = 3) -> int:
    """Words that lie in a ``width``-word window which the text has twice or more."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    windows = mixed(sum(h[i : i + n] * step(i) for i in range(width)))
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(h), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def count_all(text: bytes | None) -> tuple:
    """The values of ``COUNTS`` for UTF-8 bytes; null counts as empty."""
    text = text or b""
    words = split_words(text)
    h = hashed(words)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(b[:0x80].sum() + b[0xC0:].sum())
    space = int(b[9:14].sum() + b[32])
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = int(b[65:91].sum() + b[97:123].sum() + b[0xC0:].sum())
    upper = int(b[65:91].sum())
    return (
        len(words), points - space, int(b[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(h), len(lines), len(set(words)),
        upper, letters, int(b[48:58].sum()), int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()), int(b[33]), int(b[124]),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of each whole text: a row for each row, also where doc_id or text is null."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(count_all, SCHEMA), DDL)
