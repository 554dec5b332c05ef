"""The trigram index against a scan of every text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lettermill.operators import keywords

ODD = [("body", 1, ""), ("body", 2, "a"), ("body", 3, "ab"), ("body", 4, None), ("body", None, "abc"), ("body", 5, "Straße ÉCOLE 日本語"), ("body", 6, "𝄞𝄞x"), ("subject", 1, "abc"), ("subject", 7, "x%_y"), ("body", 8, "a\0b"), ("body", 8, "a second text of 8"), ("body", 8, "a second text of 8"), ("body", 10**12, "far away abc")]


def scanned(rows, term):
    return {(f, i) for f, i, t in rows if i is not None and t is not None and term.lower() in t.lower()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [("body", i, "".join(rng.choice("abcdeABé 日") for _ in range(rng.randrange(0, 300)))) for i in range(20, 260)]
    rows += [*ODD, ("body", 300, "the needle in it " + "x" * 50_000)]
    path = str(tmp_path_factory.mktemp("index"))
    frame = lambda part: spark.createDataFrame(part, "field string, id long, text string").withColumns({c: F.lit("clash") for c in ("block", "gram", "bucket", "ids")})
    for part in (rows[:100], rows[100:], []):
        keywords.index_texts(frame(part), path, block_rows=16, buckets=5)
    return path, rows


@pytest.mark.parametrize("term", ["abc", "a", "ab", "é", "ÉC", "日", "日本", "日本語", "𝄞", "𝄞x", "ABCD", "Straße", "%_", "x%_y", "zzz", "q", "needle in", "abcdeab", "\0", "second TEXT", "", "e a", "xxxxx"])
def test_equals_a_scan(spark, index, term):
    path, rows = index
    assert {tuple(r) for r in keywords.keyword_search(spark, path, term, buckets=5).collect()} == scanned(rows, term)


def test_many_candidates_are_joined(spark, index, monkeypatch):
    path, rows = index
    monkeypatch.setattr(keywords, "DIRECT", 3)
    for term in ("a", "ab", "abc"):
        assert {tuple(r) for r in keywords.keyword_search(spark, path, term, buckets=5).collect()} == scanned(rows, term)


def test_reads_only_blocks_with_candidates(spark, index, capsys):
    path, rows = index
    hit = keywords.keyword_search(spark, path, "needle", buckets=5)
    hit.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*\(block#\d+L? = 18\)", plan) and re.search(r"PushedFilters: \[.*EqualTo\(id,300\)", plan)
    read = hit.withColumn("file", F.input_file_name()).select("file").distinct().count()
    assert [tuple(r) for r in hit.collect()] == [("body", 300)] and read <= 1
    every = spark.read.parquet(f"{path}/texts").select(F.input_file_name().alias("f")).distinct().count()
    assert every > 15


def test_rarest_trigram_is_read(spark, index):
    path, rows = index
    found = {(r["field"], r["id"]) for r in keywords.candidates(spark, path, "abc needle", buckets=5).collect()}
    assert found == {("body", 300)} or len(found) < 5
    assert keywords.candidates(spark, path, "abcqqq", buckets=5).count() == 0


def test_folders_grow_with_the_logarithm(spark, tmp_path, monkeypatch):
    """Far ids share folders, equal texts are cut once, and short terms need no text: as a scan finds them."""
    monkeypatch.setattr(keywords, "FOLDERS", 8)
    monkeypatch.setattr(keywords, "FILE_BLOCKS", 4)
    monkeypatch.setattr(keywords, "PIECE", 40)
    rng = random.Random(8)
    rows = [("subject", i, rng.choice(["1-URGENT O", "Re: 2-HIGH F", "", "a\0b ends in a"])) for i in [*range(-40, 3000), *(rng.randrange(10**9) for _ in range(40))]]
    path = str(tmp_path / "index")
    keywords.index_texts(spark.createDataFrame(rows, "field string, id long, text string"), path, block_rows=16, buckets=3)
    for direct in (1000, 3):
        monkeypatch.setattr(keywords, "DIRECT", direct)
        for term in ("urgent", "a", "a\0", "\0", "gh", "f", "t o", "in a", "ab"):
            assert {tuple(r) for r in keywords.keyword_search(spark, path, term, buckets=3).collect()} == scanned(rows, term), term
    folders = spark.read.parquet(f"{path}/texts").select("block").distinct().collect()
    assert 20 < len(folders) < 110  # 188 blocks and 40 far ones
    assert not any("texts" in f for t in ("a", "gh", "t o") for f in keywords.keyword_search(spark, path, t, buckets=3).inputFiles())
