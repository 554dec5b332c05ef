"""Nulls, repeated ids, very long and empty texts, clashing columns and empty tables in the classifiers and the pipeline's stages."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import bpe, decontamination, language, quality_model, quality_rules, queries, toxicity

CLASHES = ("x", "y", "n", "fold", "bin", "kept", "score", "words", "terms", "lines", "hashes", "quality", "toxic", "id", "text_hash", "at", "component", "predicted")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAID = "One plain sentence about rivers, hills and the weather that nobody would reject. "


def table(spark, rows):
    """(doc_id, text) rows as documents, with columns that clash with the operators' own names."""
    made = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(made, DOCS).withColumns({c: F.lit("clash") for c in CLASHES})


def good(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Odd rows: repeated ids with one text or several, null ids and texts, a text of 60,000 words."""
    return [(1, good(1)), (1, good(1)), (2, good(2)), (2, "too short"), (3, None), (4, ""), (5, " \n\t "), (6, good(6, 60_000)), (None, good(7)), (None, None), (None, ""), (8, good(8)), (9, good(8))]


def words(t):
    return WORD.findall(t or "")


def test_quality_rules_count_every_row(spark, odd):
    out = quality_rules.quality_rules(table(spark, odd)).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in out) == Counter((i, len(words(t))) for i, t in odd)
    assert all(r["base_failed"] == (r["n_words"] < 50) and not (r["base_failed"] and r["kept"]) for r in out)
    assert {r["kept"] for r in out if r["n_words"] >= 120} == {True}


def test_normal_equations(spark):
    """Sums of Spark's tasks against one product of numpy over 200 rows."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 2, 200).astype(float)
    made = quality_model.Fourier(x.mean(axis=0), x.std(axis=0), 32, 0.7, 3)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").repartition(7)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    phi = np.array([[*(np.sqrt(2 / 32) * np.cos(sum(a * d for a, d in zip(row, made.directions[:, j])) + made.phases[j]) for j in range(32)), 1.0] for row in z])
    want = np.hstack([phi.T @ phi, (phi.T @ y)[:, None]])
    assert np.allclose(quality_model.normal_equations(rows, made), want)
    near = made(np.vstack([x[0], x[0] + 0.01, x[0] + 9]))[:, :-1]
    assert near[0] @ near[1] > 0.9 * (near[0] @ near[0]) > 0.9 * abs(near[0] @ near[2])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 4))
    made = quality_model.Fourier(np.zeros(4), np.ones(4), 20_000, 0.7, 1)
    phi = made(x)[:, :-1]
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * (0.7 * 2) ** 2))
    assert np.abs(phi @ phi.T - gauss).max() < 0.05


@pytest.mark.parametrize("operator, label", [(quality_model.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_score_every_row(spark, odd, operator, label):
    """A row for each row, equal texts equal scores, labels of null or unknown ids without effect."""
    rows = [*odd, *((100 + i, good(i) if i % 2 else "SPAM!!! | " * 40 + "vile") for i in range(40))]
    marks = [(100 + i, int(bool(i % 2) == (label == "quality"))) for i in range(40)]
    noise = [(None, 1), (None, None), (100, None), (777, 0)]
    labels = lambda m: spark.createDataFrame(m, f"doc_id long, {label} int").withColumns({"text": F.lit("clash"), "score": F.lit(1), "y": F.lit(2), "x": F.lit(3)})
    docs = table(spark, rows)
    out = operator(docs, labels(marks)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows) and all(0 <= r["score"] <= 1 for r in out)
    by: dict = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(round(r["score"], 9))
    assert by[1][0] == by[1][1] and by[8] == by[9] and set(by[3]) == set(by[4])
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    again = operator(docs, labels([*marks, *noise])).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in again) == sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in out)
    assert operator(docs.limit(0), labels(marks)).count() == 0
    repeated = operator(docs.unionByName(docs), labels(marks)).collect()
    assert Counter(r["doc_id"] for r in repeated) == Counter([i for i, _ in rows] * 2)


def test_language_of_repeated_rows(spark):
    """Repeated rows and ids: a row each, one of an id is learned from, clashing columns are not read."""
    en, de = "the river and the house of the town ", "der Fluss und das Haus der Stadt für die "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(80)]
    odd = [(1, en, "en"), (1, None, "en"), (None, de, "de"), (500, en * 20_000, None), (501, "123 !?", "en"), (502, "", None)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in (*CLASHES, "lang_pred", "grams", "counts", "all", "r")})
    out = language.language_id(make(rows + odd)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in rows + odd)
    by = {r["doc_id"]: r for r in out}
    assert by[500]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and {by[501]["lang_pred"], by[502]["lang_pred"]} == {"und"}
    twice = {(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.language_id(make(rows + rows)).collect()}
    assert {(i, p) for i, p, _ in twice} == {(i, lang) for i, _, lang in rows} and len(twice) == len(rows)


def test_vocabularies_that_are_refused(tmp_path):
    """Settings that would change ids are errors, not ignored."""
    base = json.loads(Path(queries.vocabulary()).read_text(encoding="utf-8"))
    bpe.Vocabulary(queries.vocabulary())
    token = base["added_tokens"][0]
    cutter = base["pre_tokenizer"]
    nested = {"type": "Sequence", "pretokenizers": [cutter | {"add_prefix_space": True}]}
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": cutter | {"add_prefix_space": True}}, {"pre_tokenizer": nested}, *({"added_tokens": [token | {k: True}]} for k in ("lstrip", "rstrip", "single_word"))):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(base | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))


def test_decontamination_over_chunk_seams(spark):
    """Items of a text of 30,000 words that lie across the scan's chunks of 8,192 words, and at both ends of the text."""
    rng = random.Random(3)
    vocab = ["v" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(40) for _ in range(9)]
    at = [0, 8192 - 39, 8192 - 20, 8192 - 1, 8192, 2 * 8192 - 24, 2 * 8192 + 8, 3 * 8192 - 33, 30_000 - 40]
    rows = []
    for k, (i, p) in enumerate(zip(items, at)):
        host = say(30_000)
        host[p : p + 40] = i
        rows.append((k, " ".join(host)))
    rows.append((99, " ".join(say(30_000))))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_leaks(table(spark, rows), bench).collect()}
    assert got == {(k, k) for k in range(9)}


@pytest.fixture(scope="module")
def sf_with(spark, sf_dir, tmp_path_factory):
    """A data folder with a benchmark of null and empty items beside a whole one."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, good(6)), (2, None), (3, ""), (None, good(77))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, sf_with, odd, name, stage):
    docs = table(spark, odd)
    out = stage(spark, docs, sf_with)
    got = out.collect()
    if name != "bpe_encode":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = Counter(r["doc_id"] for r in got)
    whole = Counter(i for i, _ in odd)
    assert ids[None] == 3  # rows without an id are never removed
    assert all(n == whole[i] for i, n in ids.items())  # rows of an id stay or go together
    gone = set(whole) - set(ids)
    if name == "quality_rules":
        assert gone == {2, 3, 4, 5}
    elif name == "near_dedup":
        assert gone == {9}
    elif name == "decontamination":
        assert gone == {6}  # the item is the start of the long text
    else:
        assert not gone
    empty = stage(spark, docs.limit(0), sf_with)
    assert empty.columns == out.columns and empty.count() == 0
