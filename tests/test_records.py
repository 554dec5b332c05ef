from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.operators import events, files, messages


def test_families_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03d}", "h", f"{rng.choice(['a', 'b', ''])}{rng.choice(['', '_v2', ' final'])}.pdf", rng.choice(["s1", "s2", "s3", "s4", None]), f"t{rng.randrange(25)}") for i in range(60)]
    stems = {k: n.removesuffix(".pdf").removesuffix("_v2").removesuffix(" final") for k, _, n, _, _ in rows}
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for x in rows:
            for y in rows:
                if stems[x[0]] in ("a", "b") and stems[x[0]] == stems[y[0]] and ((x[3] and x[3] == y[3]) or x[4] == y[4]):
                    root[x[0]] = root[y[0]] = min(root[x[0]], root[y[0]])
    df = spark.createDataFrame([r for r in rows if stems[r[0]]], "key string, sha256 string, filename string, sender_address string, thread_id string")
    got = {r["key"]: r["family"] for r in files.family_members(df).collect()}
    assert got == {k: v for k, v in root.items() if stems[k]}
    moved = df.filter("key in ('k000', 'k001', 'k002')").withColumn("filename", F.lit("only_once.pdf"))
    again = files.family_members(df.unionAll(moved).unionAll(df.limit(5)))  # files that come several times are one
    assert {r["key"]: r["family"] for r in again.collect()} == got and again.count() == len(got)


def test_embedding_texts_are_cut(spark):
    link = "https://x.example/" + "y" * 60 + " "
    rows = [("s", "n", "short"), ("s", None, "é" * 40_000), (None, "n", link * 700), (None, None, None)]
    out = spark.createDataFrame(rows, "s string, n string, b string").select(text.embedding_text("s", "n", "b").alias("t"), "s", "n", "b").collect()
    for r in out:
        whole = f"Subject: {r['s'] or ''}\nFrom: {r['n'] or ''}\n\n{r['b'] or ''}"
        assert whole.startswith(r["t"]) and text._tokens(r["t"]) <= 7500
        assert r["t"] == whole or text._tokens(whole[: len(r["t"]) + 1]) > 7500


def test_identities_and_scopes(spark):
    none = spark.createDataFrame([], "source_account string")
    assert [r["address"] for r in messages.identities(none, ["b", "a", "b", ""]).orderBy("pos").collect()] == ["b", "a"]
    assert [r["address"] for r in messages.identities(none, ["b"], account="me").collect()] == ["me"]
    with pytest.raises(ValueError):
        messages.identities(none, [])
    one = events.scope_fingerprint({"b": 1, "a": ["x"], "c": None})
    assert one == events.scope_fingerprint({"a": ["x"], "b": 1}) and one.startswith("qs_") and len(one) == 19


def test_versions_over_blocks(spark):
    rows = [(k, g, t) for k, g, t in zip([1, 5, 9, 40, 41, 2, 900, None], ["a", "a", "a", "a", None, None, None, "a"], ["p", "q", None, "r", "s", "", "u", "v"])]
    df = spark.createDataFrame(rows, "key long, g string, text string")
    for block_ids in (4, 1 << 16):
        got = {r["key"]: (r["new"], r["old"]) for r in files.versions(df, "g", block_ids).collect()}
        assert got == {5: ("q", "p"), 9: (None, "q"), 40: ("r", None), 41: ("s", ""), 900: ("u", "s")}
    assert files.versions(df.limit(0), "g").count() == 0
