"""Connected components of an edge table by contraction: each round merges nodes into neighbours, and only what is left goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lettermill.staging import staged


def shared_key_edges(ties: DataFrame, *keys: str) -> DataFrame:
    """(u, v) from ties (n, keys): each n beside the least n that has the same keys. Partial aggregation finds the least, so a key of
    any number of rows makes a row for each. Null keys tie nothing."""
    heads = ties.groupBy(*keys).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n")).filter("least_n < most_n").drop("most_n")
    return ties.join(heads, list(keys)).filter("n != least_n").select(F.col("n").alias("u"), F.col("least_n").alias("v"))


def merged_nodes(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(n, label) for every node of the edges (u, v) that has a link; nodes are longs, and nodes that hang together have one of them
    as their label.

    A round merges every node into the neighbour of the least rank, if that is less than its own. Ranks are the numbers themselves in
    the first round, where a star around its least node becomes one, and hashes with another seed in each later one, so that a
    constant part of the linked nodes goes whatever the graph: rounds shrink, and all together are a small multiple of the first.
    Each is staged in the shared folder. Labels then come back from the last round to the first. Minima come from partial
    aggregation, and Spark may split a skewed join. Raises ``RuntimeError`` if ``max_rounds`` leave a link.
    """
    now, rounds = edges.filter("u != v").select("u", "v"), []
    for k in range(max_rounds):
        if now.isEmpty():
            break

        def rank(c: str) -> Column:
            return F.xxhash64(c, F.lit(k)) if k else F.col(c)

        around = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = around.groupBy("u").agg(F.min_by("v", rank("v")).alias("m"))
        into = staged(near.select(F.col("u").alias("n"), F.when(rank("m") < rank("u"), F.col("m")).otherwise(F.col("u")).alias("m")), "merged")
        rounds.append(into)
        left = now.join(into.select(F.col("n").alias("u"), F.col("m").alias("a")), "u").join(into.select(F.col("n").alias("v"), F.col("m").alias("b")), "v")
        now = staged(left.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "left")
    else:
        if not now.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not rounds:
        return now.select(F.col("u").alias("n"), F.col("v").alias("label"))
    labels = rounds[-1].withColumnRenamed("m", "label")
    for into in reversed(rounds[:-1]):
        labels = into.join(labels.withColumnRenamed("n", "m"), "m", "left").select("n", F.coalesce("label", "m").alias("label"))
    return staged(labels, "labels")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Nodes may be of any ordered type; those that are not integers are numbered. Null ends and self loops make no link (a self loop
    still names its node); repeated edges count once; an empty table gives an empty result. The links are merged by
    ``merged_nodes``, so the work grows with the edges, however long the paths; the driver sees only whether a round left any.
    """
    kind = edges.select(F.array(a, b).alias("x")).schema["x"].dataType.elementType
    ends = edges.select(F.col(a).cast(kind).alias("u"), F.col(b).cast(kind).alias("v")).filter("u is not null and v is not null")
    ends = staged(ends, "edges")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if isinstance(kind, IntegralType):
        nodes = nodes.withColumn("n", F.col("node").cast("long"))
        links = ends.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    else:
        nodes = staged(nodes.withColumn("n", F.monotonically_increasing_id()), "nodes")
        numbered = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
        links = staged(ends.filter("u != v").join(numbered("u"), "u").join(numbered("v"), "v").select(F.col("n_u").alias("u"), F.col("n_v").alias("v")), "links")
    placed = nodes.join(merged_nodes(links, max_rounds), "n", "left").select("node", F.coalesce("label", "n").alias("label"))
    placed = staged(placed, "placed")
    return placed.join(placed.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
