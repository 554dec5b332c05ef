"""Operator 9, toxicity: a factorization machine over hashed terms.

A document is the set of its lower-cased words and their prefixes, hashed. Besides a weight a term the machine learns a short
vector a term; the inner products of all pairs (an insult with a group mention, two insults) add to the score, at a cost linear
in the number of terms. It is fitted in one task on a bounded sample of labelled rows; scoring is one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from lettermill.llm.quality_model import fold
from lettermill.llm.sampling import bounded_sample
from lettermill.llm.words import small
from lettermill.staging import staged

EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


@dataclass
class Terms:
    """Hashed terms of a text; buckets of frequent words are remembered within a task."""

    bits: int
    prefixes: tuple[int, ...] = (3, 4, 5)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def of_word(self, word: str) -> tuple[int, ...]:
        mask = (1 << self.bits) - 1
        return tuple(xxh32_intdigest(t.encode("utf-8", "surrogatepass")) & mask for t in [word, *(f"{word[:p]}\x00" for p in self.prefixes if len(word) > p)])

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > 100_000:
            self.known.clear()
        out: set[int] = set()
        for raw in set((text or "").lower().split()):
            at = self.known.get(raw)
            if at is None:
                word = raw.strip(EDGE)
                at = self.known[raw] = self.of_word(word) if word else ()
            out.update(at)
        return np.fromiter(out, np.int64, len(out))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # bucket
    factors: np.ndarray  # bucket x rank

    def odds(self, at: np.ndarray) -> float:
        v = self.factors[at]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[at].sum()) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.odds(at), -40, 40))))


def fit_machine(rows: list[np.ndarray], marks: np.ndarray, *, bits: int, rank: int, rate: float, l1: float, l2: float, epochs: int, min_rows: int, pair_share: float, seed: int) -> Machine:
    """Logistic loss; weights by FTRL-proximal, whose l1 penalty leaves out terms of no account, vectors by AdaGrad.

    Vectors are learned for terms with a weight, and for those in ``pair_share`` of the rows, which may count only together. Chance sums of gradients grow with the root of the number of positive rows, so l1 is given for one such row and scaled.
    Terms in fewer than ``min_rows`` rows stay out.
    """
    size = 1 << bits
    seen = np.zeros(size, np.int64)
    for r in rows:
        seen[r] += 1
    rows = [r[seen[r] >= min_rows] for r in rows]
    rng = np.random.default_rng(seed)
    z, n = np.zeros(size), np.zeros(size)
    v, gv = rng.normal(0, 0.05, (size, rank)), np.full((size, rank), 1e-2)
    paired = seen >= max(pair_share * len(rows), min_rows)
    l1 *= float(np.sqrt(max(marks.sum(), 1.0)))
    share = float(np.clip(marks.mean(), 1e-3, 1 - 1e-3)) if len(marks) else 0.5
    b, gb = float(np.log(share / (1 - share))), 1.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((1 + np.sqrt(n[at])) / rate + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            on = at[(w != 0) | paired[at]]
            va = v[on]
            total = va.sum(axis=0)
            odds = b + w.sum() + 0.5 * (total @ total - (va * va).sum())
            g = 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - marks[i]
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate * w
            n[at] += g * g
            step = g * (total - va) + 1e-3 * va
            gv[on] += step * step
            v[on] = va - 0.5 * rate * step / np.sqrt(gv[on])
    w = weights(slice(None))
    v[(w == 0) & ~paired] = 0
    return Machine(b, w.astype(np.float32), v.astype(np.float32))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, max_train_rows: int = 16_000, bits: int = 17, rank: int = 4, rate: float = 0.1, l1: float = 0.4, l2: float = 1.0, epochs: int = 6, min_rows: int = 3, pair_share: float = 0.2, threshold: float = 0.7, seed: int = 3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; a row for each row of ``docs``.

    Labels are learned only from rows outside the held-out fold of crc32(doc_id as text), ``max_train_rows`` of them at most,
    chosen by hash. Null labels and ids are passed over; several labels of a document are averaged; of a repeated doc_id one
    row is learned from. A null or empty text has no terms and gets the bias alone; without labelled rows that is 0.5. Only
    doc_id, text and labels.toxic are read. No rows give no rows.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("y"))
    known = staged(bounded_sample(marks.filter(fold(F.col("doc_id"), folds) != held_out), max_train_rows, seed), "sample")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    terms = Terms(bits)
    made = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("terms", pa.binary())])

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = [np.sort(terms(t)).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary())], schema=made)

    sample = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(termed, "doc_id long, y double, terms binary").groupBy("doc_id").agg(F.min(F.struct("y", "terms")).alias("r")).select("doc_id", "r.*")  # the broadcast and the sample hold max_train_rows at most
    model = pa.schema([("bias", pa.float64()), ("weights", pa.binary()), ("factors", pa.binary())])

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group["doc_id"].to_numpy())
        at, y = group["terms"].to_pylist(), group["y"].to_numpy()[order]
        m = fit_machine([np.frombuffer(at[i], "<i4") for i in order], y, bits=bits, rank=rank, rate=rate, l1=l1, l2=l2, epochs=epochs, min_rows=min_rows, pair_share=pair_share, seed=seed)
        return pa.table({"bias": [m.bias], "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]}, schema=model)

    fitted = sample.groupBy(F.lit(1).alias("all")).applyInArrow(lambda g: fit(g.select(["doc_id", "y", "terms"])), "bias double, weights binary, factors binary").collect()
    size = 1 << bits
    machine = Machine(fitted[0]["bias"], np.frombuffer(bytes(fitted[0]["weights"]), np.float32), np.frombuffer(bytes(fitted[0]["factors"]), np.float32).reshape(size, rank)) if fitted else Machine(0.0, np.zeros(size, np.float32), np.zeros((size, rank), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([machine.score(terms(t)) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
