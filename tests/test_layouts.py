"""Tables laid out for pages and for vector search."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import pages, retrieval, vector_store


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.2 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(25))) for i in range(500)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("pages"))
    pages.lay_out(spark.createDataFrame([*rows, (None, datetime(2024, 1, 1))], "id long, date timestamp"), path, rows_per_part=40)
    return path, rows


@pytest.mark.parametrize("descending", [False, True])
def test_pages_follow_each_other(spark, laid, descending):
    path, rows = laid
    dated = sorted(((d, i) for i, d in rows if d), reverse=descending)
    want = dated + [(None, i) for i in sorted((i for i, d in rows if d is None), reverse=descending)]
    cursor, got = None, []
    while part := pages.page(spark, path, after=cursor, limit=70, descending=descending).collect():
        got += [(r["date"], r["id"]) for r in part]
        cursor = got[-1]
    assert got == want


def test_a_page_reads_few_parts(spark, laid, capsys):
    path, rows = laid
    parts = spark.read.parquet(f"{path}/rows").select("undated", "part").distinct().count()
    for cursor in (None, (datetime(2024, 1, 12), 250), (None, 100), (datetime(2023, 1, 1), 0)):
        out = pages.page(spark, path, after=cursor, limit=30)
        out.explain("formatted")
        assert re.search(r"PartitionFilters: \[.*part#\d+ (=|IN|INSET)", capsys.readouterr().out)
        asked = pages._touched(spark.read.parquet(f"{path}/bounds").collect(), *(cursor or (None, None)), cursor is not None, False, 30)
        assert len(asked) <= 3 < parts and out.count() == 30
    assert pages.page(spark, path, after=(None, 10**9)).count() == 0
    assert pages._touched([], None, None, False, False, 5) == []


def test_a_page_lists_its_own_parts_only(spark, laid):
    """The driver hears of the parts that a page can touch, not of all; ranges of many parts keep every part within its bound."""
    path, _ = laid
    assert len(pages.page(spark, path, after=(datetime(2024, 1, 12), 250), limit=30).inputFiles()) <= 3
    held = spark.read.parquet(f"{path}/bounds")
    assert max(r["n"] for r in held.collect()) <= 40 and len(pages._ahead(held, None, 3, False)) == 5 < held.count()


def test_stored_search_equals_the_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=i % 40), None if i % 31 == 0 else [0.0] * 16 if i % 37 == 0 else rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, datetime(2024, 2, 1), rows[1][2]) for i in range(5)]  # ties
    mails = spark.createDataFrame(rows, "id long, date timestamp, embedding array<float>").repartition(6).withColumn("norm_of", F.lit("clash"))
    vector_store.store_vectors(mails, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == sum(v is not None and any(v) for *_, v in rows)
    for query, how in ((rows[1][2], {}), (rng.normal(size=16).tolist(), {"limit": 7, "offset": 3}), (rng.normal(size=16).tolist(), {"after": "2024-01-20", "limit": 50}), (rows[5][2], {"limit": 5000})):
        want = retrieval.semantic_search(mails, query, **how).select("id", F.round("similarity", 9)).collect()
        got = vector_store.stored_search(spark, f"{tmp_path}/v", query, **how).select("id", F.round("similarity", 9)).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want if r[1] is not None]
    with pytest.raises(ValueError):
        vector_store.stored_search(spark, f"{tmp_path}/v", [0.0] * 16)
