"""The corpus pipeline: documents judged, cleaned, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir) and works on every document that the stage before kept; all but the last return the
columns of documents. A document is its doc_id: rows that repeat one stay or go together. Rows without a doc_id cannot be told
apart, so no stage removes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.bpe import encode
from lettermill.llm.decontamination import benchmark_leaks
from lettermill.llm.line_dedup import line_dedup
from lettermill.llm.near_dup import near_duplicates
from lettermill.llm.quality_rules import quality_rules
from lettermill.llm.queries import vocabulary
from lettermill.staging import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality_rules(docs).filter(~F.col("kept")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows the text."""
    kept = line_dedup(docs, min_docs=10, min_chars=1, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return _without(docs, near_duplicates(docs).filter(~F.col("kept")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text that is left."""
    return encode(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encode", encode_tokens),
]

#: The weak-supervision verdict, the latent search and the encoding are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; the tables between them lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
