"""Vector and ranked retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions.vectors import cosine, dot, literal, norm, normalised
from lettermill.operators.predicates import message_filter
from lettermill.staging import staged

RANK_OFFSET = 60


def usable(vector: str | Column = "embedding") -> Column:
    """There is a vector, and it is not the all-zero mark of a failed embedding."""
    return F.coalesce(norm(vector) > 0, F.lit(False))


def semantic_search(mails: DataFrame, vector: list[float], *, limit: int = 20, offset: int = 0, **filters: Any) -> DataFrame:
    """The nearest messages that pass the filters, with ``similarity``; exact, in one pass."""
    size = float(np.linalg.norm(vector))
    near = F.try_divide(dot("embedding", literal([x / size for x in vector] if size else vector)), norm("embedding") if size else F.lit(0.0))
    rows = mails.filter(message_filter(**filters)).withColumn("similarity", near).filter("similarity is not null")
    return rows.orderBy(F.desc("similarity"), "id").offset(offset).limit(limit)


def chunk_search(chunks: DataFrame, contents: DataFrame, bridge: DataFrame, mails: DataFrame, vector: list[float], *, limit: int = 20, **filters: Any) -> DataFrame:
    """The nearest chunks of extracted attachments that some message passing the filters carries, with their parent ids."""
    kept = bridge.join(mails.filter(message_filter(**filters)).select(F.col("id").alias("email_id")), "email_id", "left_semi")
    done = contents.filter("status = 'extracted'").select("sha256")
    rows = chunks.join(done, "sha256", "left_semi").join(kept, "sha256", "left_semi").filter(usable())
    top = rows.withColumn("similarity", cosine("embedding", literal(vector))).orderBy(F.desc("similarity"), "sha256", "chunk_index").limit(limit)
    parents = bridge.join(top.select("sha256").distinct(), "sha256", "left_semi").groupBy("sha256").agg(F.array_sort(F.collect_set("email_id")).alias("email_ids"))
    return top.join(parents, "sha256", "left")


def ranked(rows: DataFrame, *order: Column, by: str | None = None) -> DataFrame:
    """``rank`` from 1 within each value of ``by``, for lists that a limit has bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by if by else F.lit(1)).orderBy(*order)))


def fuse_sources(lists: DataFrame, *, limit: int = 20, sources: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (source, id, similarity) that stand apart in each source; ``sources`` chooses among them."""
    if sources is not None:
        lists = lists.filter(F.col("source").isin(sources))
    scored = ranked(lists, F.desc("similarity"), F.asc("id"), by="source").withColumn("score", 1 / (RANK_OFFSET + F.col("rank")))
    return scored.orderBy(F.desc("score"), F.desc("similarity"), "source", "id").limit(limit)


def fuse_lists(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """id, score: the sum of both lists' reciprocal ranks (id, rank), and 1/60 more where both have the id."""
    both = exact.select("id", F.col("rank").alias("r1")).join(semantic.select("id", F.col("rank").alias("r2")), "id", "full_outer")
    part = lambda r: F.coalesce(1 / (RANK_OFFSET + F.col(r)), F.lit(0.0))
    bonus = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), 1 / F.lit(float(RANK_OFFSET))).otherwise(0.0)
    return both.select("id", (part("r1") + part("r2") + bonus).alias("score"))


def without_duplicates(cards: DataFrame, order: list[Column], *key: str) -> DataFrame:
    """The best card of each key, with ``suppressed``: how many it stands for besides itself."""
    first = Window.partitionBy(*key).orderBy(*order)
    rows = cards.withColumns({"_n": F.row_number().over(first), "suppressed": F.count(F.lit(1)).over(Window.partitionBy(*key)) - 1})
    return rows.filter("_n = 1").drop("_n")


def hybrid_search(mails: DataFrame, term_filter: Column, vector: list[float] | None, *, mode: str = "hybrid", window: int = 500, limit: int = 25, offset: int = 0, scope: Column | None = None, texts: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Ranked search over a window of each list: exact (newest first), semantic, or both fused; without a vector it is exact.

    ``texts`` (with id, date and what ``term_filter`` reads) and ``vectors`` (id, embedding) may lie apart from ``mails``, so that each list
    reads its own columns only; ``scope`` narrows both lists before they are ranked and reads ``mails``.
    """
    if mode not in ("exact", "semantic", "hybrid"):
        raise ValueError("mode must be exact, semantic or hybrid")
    if offset + limit > window:
        raise ValueError(f"only the first {window} results are ranked")
    inside = lambda t: t if scope is None else t.join(mails.filter(scope).select("id"), "id", "left_semi")
    texts, vectors = inside(mails if texts is None else texts), inside(mails if vectors is None else vectors)
    exact = ranked(texts.filter(term_filter).select("id", "date").orderBy(F.col("date").desc_nulls_last(), "id").limit(window), F.col("date").desc_nulls_last(), F.asc("id")).select("id", "rank")
    if mode == "exact" or vector is None:
        scored = exact.withColumn("score", 1 / (RANK_OFFSET + F.col("rank")))
    else:
        near = ranked(semantic_search(vectors, vector, limit=window).select("id", "similarity"), F.desc("similarity"), F.asc("id")).select("id", "rank")
        scored = fuse_lists(exact, near) if mode == "hybrid" else near.withColumn("score", 1 / (RANK_OFFSET + F.col("rank")))
    cards = mails.join(scored.select("id", "score"), "id")
    best = [F.desc("score"), F.asc("id")]
    return without_duplicates(cards, best, "subject", "sender_address", "date").orderBy(*best).offset(offset).limit(limit)


def diverse_sample(mails: DataFrame, key: str, k: int, *, pool: int = 500) -> DataFrame:
    """Up to ``k`` messages of each key that lie far apart: the newest, then always the one farthest from those taken.

    The pool is the ``pool`` newest rows of a key. Ties go to the earlier row; vectors without length are at distance 0; rows
    without a vector are never taken, unless the key has no more than ``k`` rows, which are all taken.
    """
    newest = Window.partitionBy(key).orderBy(F.col("date").desc_nulls_last(), "id")
    rows = mails.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= pool).select(key, "id", "pos", "embedding")
    id_type = mails.schema["id"].dataType.simpleString()
    key_type = mails.schema[key].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        if len(group) <= k:
            return group.assign(pick=range(1, len(group) + 1))[[key, "id", "pick"]]
        group = group[group["embedding"].notna()].reset_index(drop=True)
        if not len(group):
            return group.assign(pick=1)[[key, "id", "pick"]]
        x = np.array(group["embedding"].tolist(), float)
        size = np.linalg.norm(x, axis=1)
        unit = x / np.where(size > 0, size, 1)[:, None]
        far = np.where(size > 0, np.inf, 0.0)
        taken = [0]
        for _ in range(min(k, len(group)) - 1):
            far = np.minimum(far, np.where(size > 0, 1 - unit @ unit[taken[-1]], 0.0))
            far[taken] = -1
            taken.append(int(far.argmax()))
        return group.iloc[taken].assign(pick=range(1, len(taken) + 1))[[key, "id", "pick"]]

    return rows.groupBy(key).applyInPandas(pick, f"`{key}` {key_type}, id {id_type}, pick int")


def diverse_overall(mails: DataFrame, k: int, *, pool: int = 500) -> DataFrame:
    """id, pick: up to ``k`` messages of all rows that lie far apart, by the rules of ``diverse_sample`` over the ``pool`` newest."""
    newest = mails.select("id", "date", "embedding").orderBy(F.col("date").desc_nulls_last(), "id").limit(pool)
    return diverse_sample(newest.withColumn("one", F.lit(1)), "one", k, pool=pool).select("id", "pick")


class VectorCells:
    """Approximate search: vectors lie in k-means cells, a query reads the nearest few; ``nearest`` adds the cells that can hold more.

    The centroids are fitted on ``fit_rows`` rows at most; every row is assigned. The table is written partitioned by cell, so a
    search reads only the probed partitions.
    """

    def __init__(self, rows: DataFrame, path: str, *, cells: int = 16, fit_rows: int = 50_000, seed: int = 13) -> None:
        unit = rows.filter(usable()).withColumn("unit", normalised("embedding"))
        share = min(1.0, fit_rows / max(unit.count(), 1))
        train = (unit if share == 1.0 else unit.sample(share, seed)).select(array_to_vector("unit").alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=25, tol=1e-4, distanceMeasure="cosine").fit(train)
        self.centres = [np.array(c) / max(float(np.linalg.norm(c)), 1e-12) for c in model.clusterCenters()]
        placed = model.setPredictionCol("cell").transform(unit.withColumn("features", array_to_vector("unit")))
        placed.drop("features", "unit").write.mode("overwrite").partitionBy("cell").parquet(path)
        self.path, self.spark = path, rows.sparkSession

    def search(self, vector: list[float], *, limit: int = 20, probes: int = 4) -> DataFrame:
        v = np.array(vector) / max(float(np.linalg.norm(vector)), 1e-12)
        near = np.argsort([-float(c @ v) for c in self.centres])[:probes].tolist()
        rows = self.spark.read.parquet(self.path).filter(F.col("cell").isin(near))
        return rows.withColumn("similarity", cosine("embedding", literal(vector))).orderBy(F.desc("similarity"), "id").limit(limit)

    def radii(self) -> np.ndarray:
        """The angle between each cell's centre and its farthest vector; -1 for empty cells."""
        centres = np.array(self.centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.array(b["embedding"].tolist(), float)
                angle = np.arccos(np.clip((x / np.linalg.norm(x, axis=1)[:, None] * centres[b["cell"]]).sum(axis=1), -1, 1))
                yield pd.DataFrame({"cell": b["cell"], "angle": angle}).groupby("cell", as_index=False).max()

        rows = self.spark.read.parquet(self.path).select("cell", "embedding").mapInPandas(run, "cell int, angle double")
        out = np.full(len(centres), -1.0)
        for r in rows.groupBy("cell").agg(F.max("angle").alias("angle")).collect():
            out[r["cell"]] = r["angle"]
        return out

    def _best(self, ids: list, vectors: np.ndarray, wanted: np.ndarray, limit: int) -> DataFrame:
        """query_id, id, similarity: the nearest of each batch in the cells that ``wanted`` (query x cell) names."""
        id_type = self.spark.read.parquet(self.path).schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for cell, part in b.groupby("cell"):
                    asked = np.flatnonzero(wanted[:, cell])
                    part = part.sort_values("id")
                    x = np.array(part["embedding"].tolist(), float)
                    near = vectors[asked] @ (x / np.linalg.norm(x, axis=1)[:, None]).T
                    top = np.argsort(-near, axis=1, kind="stable")[:, :limit]
                    yield pd.DataFrame({"query_id": [ids[k] for k in asked for _ in range(top.shape[1])], "id": part["id"].to_numpy()[top.ravel()], "similarity": np.take_along_axis(near, top, 1).ravel()})

        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        return self.spark.read.parquet(self.path).filter(F.col("cell").isin(cells)).select("id", "embedding", "cell").mapInPandas(run, f"query_id {id_type}, id {id_type}, similarity double")

    def nearest(self, queries: DataFrame, *, limit: int = 20, probes: int = 8, block: int = 1000) -> DataFrame:
        """query_id, id, similarity: the nearest rows of every query (id, embedding), in blocks of ``block`` queries or so; exact.

        The ``probes`` nearest cells come first. A further cell is read for the queries that it can serve: its centre's angle
        less its radius leaves room for a row nearer than the last one found.
        """
        asked = queries.filter(usable()).select("id", "embedding")
        blocks = max(1, -(-asked.count() // block))
        radii, centres, found = self.radii(), np.array(self.centres), None
        first = lambda t: ranked(t, F.desc("similarity"), F.asc("id"), by="query_id").filter(F.col("rank") <= limit).drop("rank")
        for k in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
            if not rows:
                continue
            ids, x = [r["id"] for r in rows], np.array([r["embedding"] for r in rows], float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            angle = np.arccos(np.clip(x @ centres.T, -1, 1))
            probed = np.argsort(np.argsort(angle, axis=1), axis=1) < probes
            one = staged(first(self._best(ids, x, probed, limit)), "near")
            last = {r["query_id"]: r["last"] for r in one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("last")).filter(F.col("n") >= limit).collect()}
            room = np.cos(np.maximum(angle - radii, 0)) + 1e-9 >= np.array([last.get(i, -2.0) for i in ids])[:, None]
            more = room & ~probed & (radii >= 0)
            if more.any():
                one = first(one.unionByName(self._best(ids, x, more, limit)))
            found = one if found is None else found.unionByName(one)
        kind = self.spark.read.parquet(self.path).schema["id"].dataType.simpleString()
        return self.spark.createDataFrame([], f"query_id {kind}, id {kind}, similarity double") if found is None else found


__all__ = ["VectorCells", "chunk_search", "diverse_sample", "fuse_lists", "fuse_sources", "hybrid_search", "ranked", "semantic_search", "usable", "without_duplicates"]
