"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def bounded_sample(labelled: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, ...): the same ones for the same input, chosen by a hash of doc_id."""
    n = labelled.count()
    if n <= bound:
        return labelled
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_PARTS))
    return labelled.filter(part < int(_PARTS * bound / n)).orderBy(part, "doc_id").limit(bound)
