"""Operator 7, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents: every task sums its own and Spark adds the parts up. The weights are
fitted in one task by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, on a bounded sample of
training documents whose texts become counted grams before they move, so a very long one is no larger than the number of buckets;
then they are calibrated by a temperature on sampled documents that the fit has not seen. Scoring is one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.counts import summed
from lettermill.llm.quality_model import fold
from lettermill.llm.sampling import bounded_sample
from lettermill.llm.words import small
from lettermill.staging import staged

LETTER = regex.compile(r"\p{L}")


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed 1-, 2- and 3-grams of the lower-cased code points; ASCII signs and digits count as spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.where((points < 128) & ~((points >= 97) & (points <= 122)), np.uint64(32), points)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    points = points[~((points == 32) & (np.roll(points, 1) == 32) & (np.arange(len(points)) > 0))]
    codes = [points + np.uint64(1 << 60)]
    if len(points) > 1:
        codes.append(points[:-1] + (points[1:] << np.uint64(21)) + np.uint64(2 << 60))
    if len(points) > 2:
        codes.append(points[:-2] + (points[1:-1] << np.uint64(21)) + (points[2:] << np.uint64(42)))
    at = (np.concatenate(codes) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    counts = np.bincount(at.astype(np.int64), minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    temperature: float
    bits: int

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, TF-IDF weight) of counted grams, of unit length."""
        x = (1 + np.log(counts)) * self.idf[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-12)

    def chances(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[at] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0
        p = self.chances(*self.vector(*grams(text, self.bits)))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Documents in which each bucket occurs, over all rows of ``docs`` (text), and the number of documents."""

    def add(total: np.ndarray, texts: list[str]) -> None:
        for t in texts:
            total[grams(t, bits)[0]] += 1

    return summed(docs.select("text"), add, (1 << bits,), np.int64)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, n_classes: int, size: int, *, rate: float, l1: float, l2: float, epochs: int, seed: int) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates for softmax regression; l1 and l2 are the elastic-net penalties."""
    z, n, w = (np.zeros((size, n_classes), np.float32) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            at, x = vectors[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(ni)) / rate + l2))
            s = x @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[marks[i]] -= 1
            g = np.outer(x, p).astype(np.float32)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rate * wi
            n[at] = ni + g * g
    np.copyto(w, np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate + l2)))
    return w


def temperature_of(scores: np.ndarray, marks: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search on its logarithm."""
    if not len(marks):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(marks)), marks]).mean())

    low, high, ratio = -1.5, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_language(docs: DataFrame, *, folds: int, held_out: int, max_train_rows: int, bits: int, rate: float, l1: float, l2: float, epochs: int, seed: int) -> LanguageModel:
    learn = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(fold(F.col("doc_id"), folds) != held_out)
    counts, n = frequencies(learn, bits)
    idf = (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)
    ids = staged(bounded_sample(learn.select("doc_id").distinct(), max_train_rows, seed), "sample")
    kept = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("grams", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [np.stack(grams(t, bits)).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], schema=kept)

    bags = learn.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text").mapInArrow(counted, "doc_id long, lang string, grams binary")
    sample = bags.groupBy("doc_id").agg(F.min(F.struct("lang", "grams")).alias("r")).select("doc_id", "r.*")  # max_train_rows rows of at most 2 ** bits grams
    blank = LanguageModel([], idf, np.zeros((1 << bits, 0), np.float32), 1.0, bits)
    schema = pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("temperature", pa.float64())])

    def fit(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["doc_id"].to_pylist(), group["lang"].to_pylist(), group["grams"].to_pylist()))
        languages = sorted({r[1] for r in rows})
        vectors = [blank.vector(*np.frombuffer(r[2], "<i4").reshape(2, -1)) for r in rows]
        marks = np.array([languages.index(r[1]) for r in rows])
        aside = np.array([i % 5 == 4 for i in range(len(rows))])
        seen = np.flatnonzero(~aside)
        w = ftrl([vectors[i] for i in seen], marks[seen], len(languages), 1 << bits, rate=rate, l1=l1, l2=l2, epochs=epochs, seed=seed)
        scores = np.array([vectors[i][1] @ w[vectors[i][0]] for i in np.flatnonzero(aside)]).reshape(-1, len(languages))
        return pa.table({"languages": [languages], "weights": [w.tobytes()], "temperature": [temperature_of(scores, marks[aside])]}, schema=schema)

    made = sample.groupBy(F.lit(1).alias("all")).applyInArrow(lambda g: fit(g.select(["doc_id", "lang", "grams"])), "languages array<string>, weights binary, temperature double").collect()
    if not made:
        return blank
    r = made[0]
    return LanguageModel(list(r["languages"]), idf, np.frombuffer(bytes(r["weights"]), np.float32).reshape(1 << bits, -1), r["temperature"], bits)


def language_id(docs: DataFrame, *, folds: int = 4, held_out: int = 2, max_train_rows: int = 6000, bits: int = 15, rate: float = 0.5, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1); a row for each row of ``docs``.

    Learned from text and non-null lang of documents outside the held-out fold of crc32(doc_id as text): document frequencies
    from all of them, weights and temperature from ``max_train_rows`` of them at most, chosen by hash. A null text or one
    without a letter is ``und`` with score 0, and so is every text where there is nothing to learn from. Rows with a
    null doc_id are predicted but not learned from; of a repeated doc_id one row is learned from. Only doc_id, text and lang
    are read. No rows give no rows.
    """
    model = train_language(docs, folds=folds, held_out=held_out, max_train_rows=max_train_rows, bits=bits, rate=rate, l1=l1, l2=l2, epochs=epochs, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
