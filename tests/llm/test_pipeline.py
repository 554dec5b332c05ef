"""Each stage of the pipeline on its own input, against brute force or the operator's own verdicts."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import decontamination, queries
from lettermill.staging import staged


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, sf_dir), name)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe_encode"]
    for n, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[n].columns == list(corpus_pipeline.COLUMNS)


def test_stages_take_effect(spark, sf_dir, stages):
    first, lined, single, clean = (texts(stages[n]) for n, _ in corpus_pipeline.STAGES[:-1])
    ids = stages["bpe_encode"].collect()
    start = texts(stages["in"])
    assert set(first) < set(start) and all(start[i] == t for i, t in first.items())
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").join(stages["in"].filter(F.size(F.split("text", r"\s+")) > 60), "doc_id")
    assert np.mean([r["doc_id"] in first for r in good.collect()]) > 0.95
    common: dict = {}
    low = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    for i, t in first.items():
        for k in {key(x) for x in t.split("\n")} - {""}:
            common.setdefault(k, set()).add(i)
    assert lined == {i: "\n".join(x for x in t.split("\n") if not key(x) or len(common[key(x)]) < 10) for i, t in first.items()}
    assert set(single) <= set(lined) and all(lined[i] == t for i, t in single.items())
    bench = [r["text"].lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda t: any(" " + " ".join(b) + " " in f" {' '.join(t.lower().split())} " for b in bench)
    assert not any(holds(t) for t in clean.values()) and all(holds(t) for i, t in single.items() if i not in clean)
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.vocabulary())
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in ids} == {i: coder.encode(t, add_special_tokens=False).ids for i, t in clean.items()}


def test_run_equals_stages(spark, sf_dir, stages):
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"]: r["n_tokens"] for r in stages["bpe_encode"].collect()}


def test_orthonormal_in_little_memory():
    """The same span as a QR of the whole, in less than the double-precision copy that it takes."""
    a = np.random.default_rng(1).normal(size=(32768, 136)).astype(np.float32) * np.logspace(0, -3, 136).astype(np.float32)
    tracemalloc.start()
    q = decontamination.orthonormal(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.linalg.qr(a)[0]
    assert q.dtype == np.float32 and np.abs(q.T @ q - np.eye(136)).max() < 1e-5 and np.abs(q @ (q.T @ whole) - whole).max() < 1e-4
    assert peak < 2.8 * a.nbytes
