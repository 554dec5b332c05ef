"""Topics: clustering, terms, assignment, regeneration, projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions.vectors import normalised
from lettermill.operators.retrieval import usable

#: Words that name no topic (fixed values).
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other",
    "our", "ours", "ourselves", "out", "over", "own", "re", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves", "fw", "fwd", "subject",
)


def cluster(mails: DataFrame, k: int, *, seed: int = 13, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(key, topic) of every usable vector and (topic, centroid): spherical k-means over all rows, k-means|| start, 25 rounds at most."""
    rows = mails.filter(usable()).select(key, array_to_vector(normalised("embedding")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=25, tol=1e-4, distanceMeasure="cosine", initMode="k-means||", predictionCol="topic").fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return model.transform(rows).select(key, "topic"), mails.sparkSession.createDataFrame(centres, "topic int, centroid array<double>")


def assign(rows: DataFrame, centroids: DataFrame, *, key: str = "id", max_centroids: int = 4096) -> DataFrame:
    """key, topic, distance: the nearest centroid by cosine distance, ties to the smallest topic; batch or stream.

    Centroids are the model's parameters: there may be ``max_centroids`` at most, and only then do they travel with the tasks, which
    multiply matrices of Arrow batches. Nothing is shuffled. Rows without a usable vector have no row.
    """
    held = centroids.select("topic", "centroid").orderBy("topic").limit(max_centroids + 1).collect()
    if len(held) > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids")
    names = np.array([r["topic"] for r in held], dtype=np.int32)
    centres = np.array([r["centroid"] for r in held], dtype=float)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("topic int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"topic": pd.Series(dtype="int32"), "distance": pd.Series(dtype="float64")})
        x = np.array(vectors.tolist(), dtype=float)
        size = np.linalg.norm(x, axis=1)
        far = 1 - (x / np.where(size > 0, size, 1)[:, None]) @ centres.T
        best = far.argmin(axis=1)
        return pd.DataFrame({"topic": names[best], "distance": np.where(size > 0, far[np.arange(len(x)), best], np.nan)})

    near = rows.filter("embedding is not null and size(embedding) > 0").select(key, nearest("embedding").alias("m"))
    return near.select(key, "m.topic", "m.distance").filter("distance is not null and not isnan(distance)")


def top_terms(rows: DataFrame, *, key: str = "topic", text: str = "subject", top: int = 5, min_length: int = 3) -> DataFrame:
    """key, terms, label: the most frequent terms that are no stopwords (ties by term), and the first three as a label."""
    tokens = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    counts = rows.select(key, tokens.alias("term")).filter((F.length("term") >= min_length) & ~F.col("term").isin(*STOPWORDS)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    some = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top)
    listed = some.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    every = rows.select(key).distinct().join(listed, key, "left")
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    return every.select(key, terms.alias("terms"), F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 3), ", ")).otherwise("untitled topic").alias("label"))


def regenerate(topics: DataFrame, members: DataFrame, new_topics: DataFrame, new_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, members): automatic topics are replaced, but curated, manual, hidden and manually-membered ones stay; generation goes up.

    ``new_topics`` has id, label, centroid, top_terms, ``new_members`` topic_id, email_id, distance.
    """
    by_hand = members.filter("origin = 'manual'").select(F.col("topic_id").alias("id")).distinct().withColumn("touched", F.lit(True))
    keep = topics.join(by_hand, "id", "left").filter("origin <> 'automatic' or hidden or touched").drop("touched")
    generation = topics.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))
    fresh = new_topics.crossJoin(generation).select("id", "label", F.lit("automatic").alias("origin"), F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("hidden"), "centroid", "top_terms", "generation")
    kept_members = members.join(keep.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
    all_members = kept_members.unionByName(new_members.withColumn("origin", F.lit("automatic")))
    counts = all_members.groupBy(F.col("topic_id").alias("id")).agg(F.count(F.lit(1)).alias("member_count"))
    rows = keep.drop("member_count").unionByName(fresh).join(counts, "id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))
    return rows, all_members


def with_overlay(members: DataFrame, includes: DataFrame, excludes: DataFrame) -> DataFrame:
    """Members after manual includes (topic_id, email_id), which win, and excludes."""
    left = members.join(excludes.select("topic_id", "email_id"), ["topic_id", "email_id"], "left_anti").join(includes.select("topic_id", "email_id"), ["topic_id", "email_id"], "left_anti")
    added = includes.select("topic_id", "email_id").distinct().withColumn("origin", F.lit("manual"))
    return left.unionByName(added, allowMissingColumns=True)


def representatives(members: DataFrame, n: int = 5) -> DataFrame:
    """The nearest members of each topic; members without a distance come last, newest first."""
    best = Window.partitionBy("topic_id").orderBy(F.col("distance").asc_nulls_last(), F.col("date").desc_nulls_last(), "email_id")
    return members.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def projection(vectors: DataFrame, key: str, column: str = "centroid") -> DataFrame:
    """key, x, y: the first two principal components, scaled to [-1, 1]; each axis points where its largest loading is positive."""
    rows = vectors.select(key, array_to_vector(column).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    placed = model.transform(rows).select(key, vector_to_array("p").alias("p")).select(key, *((F.col("p")[i] * signs[i]).alias(a) for i, a in enumerate("xy")))
    mid = placed.agg(*(F.avg(a).alias(f"m{a}") for a in "xy"))
    centred = placed.crossJoin(mid).select(key, *((F.col(a) - F.col(f"m{a}")).alias(a) for a in "xy"))
    reach = centred.agg(*(F.max(F.abs(F.col(a))).alias(f"r{a}") for a in "xy"))
    scaled = lambda a: F.when(F.col(f"r{a}") > 0, F.col(a) / F.col(f"r{a}")).otherwise(0.0).alias(a)
    return centred.crossJoin(reach).select(key, *(scaled(a) for a in "xy"))


def coverage(members: DataFrame, mails: DataFrame) -> DataFrame:
    """topic_members, messages, ratio (null without messages)."""
    n = members.select("email_id").distinct().agg(F.count(F.lit(1)).alias("topic_members"))
    return n.crossJoin(mails.agg(F.count(F.lit(1)).alias("messages"))).withColumn("ratio", F.when(F.col("messages") > 0, F.col("topic_members") / F.col("messages")))
