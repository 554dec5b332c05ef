from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.operators import cards, components, embedding, files, threads, topics
from lettermill.operators.components import connected_components
from lettermill.streaming import jobs


def test_embedding_failures(spark):
    def fragile(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot embed")
        return embedding.hashing_model(8)(texts)

    rows = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", None)], "id string, text string")
    by = {r["id"]: r for r in embedding.embedded(rows, fragile, dimensions=8).collect()}
    assert by["a"]["ok"] and not by["b"]["ok"] and set(by["b"]["embedding"]) == {0.0} and by["c"]["ok"]
    chunks = spark.createDataFrame([("x", 0, "fine"), ("x", 1, "bad"), ("y", 0, "good")], "sha256 string, chunk_index int, text string")
    good, bad = embedding.embed_chunks(chunks, fragile, dimensions=8)
    assert [r["sha256"] for r in good.collect()] == ["y"] and [r["sha256"] for r in bad.collect()] == ["x"]
    stored = good.select("sha256", "chunk_index", "text", "embedding").unionByName(spark.createDataFrame([("z", 0, "later", [0.0] * 8)], "sha256 string, chunk_index int, text string, embedding array<float>"))
    again, gone = embedding.reembed_zero(stored, fragile, dimensions=8)
    assert {r["sha256"] for r in again.collect()} == {"y", "z"} and gone.count() == 0


def test_assign_and_overlay(spark):
    mails = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", None)], "id string, embedding array<float>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>")
    assert {r["id"]: r["topic"] for r in topics.assign(mails, centres).collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        topics.assign(mails, centres, max_centroids=1)
    members = spark.createDataFrame([("t", "a", 0.1, "automatic"), ("t", "b", 0.2, "automatic")], "topic_id string, email_id string, distance double, origin string")
    pick = lambda *p: spark.createDataFrame(list(p), "topic_id string, email_id string")
    assert {(r["email_id"], r["origin"]) for r in topics.with_overlay(members, pick(("t", "z")), pick(("t", "a"))).collect()} == {("b", "automatic"), ("z", "manual")}


def test_clusters_separate(spark):
    rows = spark.createDataFrame([(str(i), [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(20)], "id string, embedding array<float>")
    placed, centres = topics.cluster(rows, 2)
    by = {r["id"]: r["topic"] for r in placed.collect()}
    assert len({by[str(i)] for i in range(1, 20, 2)}) == 1 and by["0"] != by["1"] and centres.count() == 2


def test_components_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), (7, None), (2000, 2000)], "a long, b long")
    by = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert all(by[i] == 0 for i in range(301)) and all(by[1000 + i] == 1000 for i in range(400)) and by[2000] == 2000
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_components_shrink_by_round(spark, monkeypatch):
    """Long paths, a star and pairs, as numbers and as names: what all rounds write is a small multiple of the edges, and labels are the least."""
    rng = random.Random(5)
    names = rng.sample(range(-(10**6), 10**6), 4000)
    edges = [*zip(names[:2999], names[1:3000]), *((names[3000], x) for x in names[3001:3800]), *zip(names[3800::2], names[3801::2])]
    parts = [names[:3000], names[3000:3800], *(names[i : i + 2] for i in range(3800, 4000, 2))]
    written = []
    real = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name="table": written.append(real(df, name)) or written[-1])
    for kind, of in (("int", int), ("string", str)):
        written.clear()
        rows = [(of(a), of(b)) if rng.random() < 0.5 else (of(b), of(a)) for a, b in edges]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*rows, *rows[:50], (of(7), of(7))], f"a {kind}, b {kind}"), "a", "b").collect()}
        want = {of(x): min(map(of, p)) for p in parts for x in p}
        assert got == {of(7): of(7), **want}
        assert sum(t.count() for t in written) < 10 * len(edges)


def test_components_that_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, "a", "b", max_rounds=1)


def test_tree_and_families(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "id string, parent_id string")
    assert {r["id"]: (r["path"], r["depth"]) for r in threads.tree_paths(nodes).collect()} == {"a": ("a", 0), "b": ("a > b", 1), "c": ("a > b > c", 2), "d": ("d", 0)}
    rows = spark.createDataFrame([("1", "h1", "r_v1.pdf", "s", "t1"), ("2", "h2", "r_v2.pdf", "s", "t2"), ("3", "h1", "r.pdf", "x", "t1"), ("4", "h4", "", "s", "t1")], "key string, sha256 string, filename string, sender_address string, thread_id string")
    got = {(r["a"], r["b"]): r["confidence"] for r in files.families(rows, spark.createDataFrame([("1",), ("4",)], "key string")).collect()}
    assert got == {("1", "1"): "exact-duplicate", ("1", "2"): "probable-version", ("1", "3"): "exact-duplicate", ("4", "4"): "exact-duplicate"}


def test_cards(spark):
    r = spark.range(1).select(cards.text_page(F.lit("abcdef"), 2, 3).alias("p"), cards.text_page(F.lit("ab"), 5, 3).alias("q"), cards.text_context(F.lit("abcdef"), F.lit(2), F.lit(4), 1).alias("c")).first()
    assert (r["p"]["page"], r["p"]["truncated"], r["q"]) == ("cde", True, None) and (r["c"]["excerpt"], r["c"]["before"], r["c"]["after"]) == ("cd", "b", "e")


def test_stream_topics_and_spikes(spark, tmp_path):
    mails = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 2.0])], "id string, embedding array<float>")
    mails.write.parquet(f"{tmp_path}/in")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>")
    stream = jobs.read_files(spark, f"{tmp_path}/in", mails.schema)
    jobs.run_available(jobs.assigned_topics(stream, centres), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r["id"]: r["topic"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": 0, "b": 1}
    day = lambda n: datetime(2025, 1, n)
    spikes = spark.createDataFrame([("s", day(1), 5), ("s", day(4), 6), ("s", day(8), 7)], "series string, day timestamp, cnt long")
    rows = jobs.spike_sessions(spikes).orderBy("first_spike").collect()
    assert [(r["first_spike"], r["last_spike"], r["spike_total"]) for r in rows] == [(day(1), day(4), 11), (day(8), day(8), 7)]


def test_stream_first_of_each_id(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 3}", datetime(2025, 1, 1, 0, i)) for i in range(9)], "message_id string, created_at timestamp")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_files(spark, f"{tmp_path}/in", rows.schema, per_trigger=1)
    jobs.run_available(jobs.first_of_each_id(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r["message_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["m0", "m1", "m2"]


def test_deep_trees_and_cycles(spark):
    """A chain of 100, a bush under it, and cycles: marked or an error, never lost."""
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(1000 + i, 99) for i in range(20)]
    want = {i: (" > ".join(map(str, range(i + 1))), i) for i in range(100)} | {1000 + i: (" > ".join(map(str, range(100))) + f" > {1000 + i}", 100) for i in range(20)}
    tree = lambda r, **how: {x["id"]: (x["path"], x["depth"]) for x in threads.tree_paths(spark.createDataFrame(r, "id long, parent_id long"), **how).collect()}
    assert tree(rows) == want
    loops = [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2002), (3000, 3000), (4000, 9999)]
    assert tree(rows + loops, cycles="mark") == want | {i: (None, None) for i, _ in loops[:5]} | {4000: ("4000", 0)}
    with pytest.raises(ValueError):
        tree(rows + loops)
    with pytest.raises(ValueError):
        tree([(1, None), (1, None)])
    assert tree([]) == {}
