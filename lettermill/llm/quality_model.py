"""Operator 5, quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Every task sums its rows' part of the normal equations; Spark adds the parts up row
by row of the matrix, and the driver solves one system of fixed size. The calibration is fitted on score bins, also of fixed
number, of labelled rows that the ridge fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.counts import summed
from lettermill.llm.stats import document_stats
from lettermill.staging import staged


def features() -> list[Column]:
    """Bounded numbers made of the counts of ``document_stats``."""
    c = lambda name: F.col(name).cast("double")
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return [
        F.log1p(c("n_words")), F.least(share("word_chars", "n_words"), F.lit(30.0)), F.least(share("n_symbols", "n_words"), F.lit(3.0)),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), F.log1p(share("n_words", "n_lines")), share("n_distinct_words", "n_words"),
        share("n_upper", "n_letters"), share("n_letters", "word_chars"), share("n_digits", "word_chars"), share("n_marks", "word_chars"),
        F.least(share("n_exclaims", "n_words"), F.lit(3.0)), F.least(share("n_pipes", "n_words"), F.lit(3.0)),
    ]


class Fourier:
    """Random features whose inner products approximate a Gaussian kernel on standardised inputs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.size = mean, scale, size
        self.directions = rng.normal(0, 1 / (width * np.sqrt(len(mean))), (len(mean), size))
        self.phases = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / self.size) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def normal_equations(rows: DataFrame, made: Fourier) -> np.ndarray:
    """The sum of [phi phi', phi y] over rows (x array<double>, y double): tasks sum their rows, and their parts are merged level by level."""
    n = made.size + 1

    def add(total: np.ndarray, values: list) -> None:
        phi = made(np.array([v["x"] for v in values], float))
        total += phi.T @ np.hstack([phi, np.array([v["y"] for v in values], float)[:, None]])

    return summed(rows.select(F.struct("x", "y")), add, (n, n + 1), float)[0]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators); x ascending."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([xi, xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, b, wb = blocks.pop()
            lo, _, a, wa = blocks.pop()
            blocks.append([lo, hi, (a * wa + b * wb) / (wa + wb), wa + wb])
    return np.array([v for lo, hi, *_ in blocks for v in (lo, hi)]), np.array([v for _, _, m, _ in blocks for v in (m, m)])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, size: int = 256, width: float = 0.7, ridge: float = 1e-2, threshold: float = 0.3, bins: int = 1000, seed: int = 17) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; a row for each row of ``docs``.

    Labels are learned only from rows of other folds than ``held_out``; one of those folds serves the calibration alone. Null
    labels and ids are passed over, several labels of a document are averaged. A null or empty text is scored by its zero
    counts. Without labelled rows every score is 0.5. Rows with null or repeated doc_ids are scored each. Only doc_id, text
    and labels.quality are read. No rows give no rows.
    """
    stats = staged(document_stats(docs).select("doc_id", F.array(*features()).alias("x")), "features")
    marks = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = stats.join(marks.filter(fold(F.col("doc_id"), folds) != held_out), "doc_id").withColumn("fold", fold(F.col("doc_id"), folds))
    known = staged(known.select("x", "y", "fold"), "known")
    d = len(features())
    moments = known.agg(F.count(F.lit(1)), *(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(d))).first()
    if not moments[0]:
        return _scored(stats, lambda x: np.full(len(x), 0.5), folds, held_out, threshold)
    mean, scale = np.array(moments[1 : 1 + d]), np.maximum(np.array(moments[1 + d :]), 1e-6)
    made = Fourier(mean, scale, size, width, seed)
    aside = (held_out + folds - 1) % folds
    sums = normal_equations(known.filter(F.col("fold") != aside), made)
    weights = np.linalg.solve(sums[:, :-1] + ridge * np.eye(size + 1), sums[:, -1])
    raw = lambda x: made(x) @ weights
    low, high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip((raw(matrix(b.column(0))) - low) / (high - low) * bins, 0, bins - 1) if len(b) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(1)], names=["bin", "y"])

    steps = known.filter(F.col("fold") == aside).select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    knots = isotonic(*(np.array(v, float) for v in zip(*((low + (high - low) * (r["bin"] + 0.5) / bins, r["y"], r["n"]) for r in steps)))) if steps else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return _scored(stats, lambda x: np.clip(np.interp(raw(x), *knots), 0, 1), folds, held_out, threshold)


def _scored(stats: DataFrame, score, folds: int, held_out: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(matrix(b.column(1))) if len(b) else [], pa.float64())], names=["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
