"""Embedding jobs around a pluggable model: a function from texts to vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators.retrieval import usable

Model = Callable[[list[str]], list[list[float]]]


def hashing_model(dimensions: int = 64) -> Model:
    """A deterministic model: signed hashed words, scaled to length one; a text without words gives zeros."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimensions)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1 if h >> 63 else -1
            size = float(np.linalg.norm(v))
            out.append((v / size if size else v).tolist())
        return out

    return run


def embedded(rows: DataFrame, model: Model, *, key: str = "id", text: str = "text", dimensions: int = 64, batch: int = 50) -> DataFrame:
    """key, embedding, ok: a failing batch is tried text by text; a text that fails gets zeros and ok = false."""
    kind = rows.schema[key].dataType.simpleString()

    def one(t: str) -> tuple[list[float], bool]:
        try:
            return list(model([t])[0]), True
        except Exception:  # the mark of a text that cannot be embedded
            return [0.0] * dimensions, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                texts = part[text].fillna("").tolist()
                try:
                    made = [(list(v), True) for v in model(texts)]
                except Exception:
                    made = [one(t) for t in texts]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [m[0] for m in made], "ok": [m[1] for m in made]})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>, ok boolean")


def missing_vectors(mails: DataFrame) -> DataFrame:
    """Messages that have no vector yet; zero vectors count as tried."""
    return mails.filter("embedding is null")


def embed_chunks(chunks: DataFrame, model: Model, *, group: str = "sha256", dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, failed groups): one failed chunk fails its whole attachment, so no zero vector is stored."""
    keyed = chunks.withColumn("_k", F.concat_ws("\x00", F.col(group).cast("string"), F.col("chunk_index").cast("string")))
    made = embedded(keyed, model, key="_k", dimensions=dimensions)
    rows = keyed.join(made, "_k").drop("_k")
    bad = rows.groupBy(group).agg(F.bool_and("ok").alias("fine")).filter("not fine").select(group)
    return rows.join(bad, group, "left_anti").drop("ok"), bad


def reembed_zero(chunks: DataFrame, model: Model, *, group: str = "sha256", dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(chunks after zero vectors were made anew, groups that failed again and lose their chunks)."""
    zero = chunks.filter(~usable()).drop("embedding")
    good, bad = embed_chunks(zero, model, group=group, dimensions=dimensions)
    return chunks.filter(usable()).unionByName(good.select(*chunks.columns)).join(bad, group, "left_anti"), bad
