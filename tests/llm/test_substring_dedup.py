"""Operator 12 against sets of windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import substring_dedup as sd
from lettermill.llm.words import hashed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    clashes = {c: F.lit("clash") for c in ("text_hash", "spans", "anchor", "words", "owner", "low", "n", "held", "start")}
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(clashes)


def expected(rows, width):
    """(doc_id, n_words, n_removed, kept) of each row, by the windows of smaller doc_ids."""
    said = [(i, WORD.findall(t or "")) for i, t in rows]
    owner = {}
    for i, w in said:
        if i is not None:
            for a in range(len(w) - width + 1):
                k = tuple(w[a : a + width])
                owner[k] = min(owner.get(k, i), i)
    for i, w in said:
        gone = set()
        for a in range(len(w) - width + 1 if i is not None else 0):
            if owner[tuple(w[a : a + width])] < i:
                gone.update(range(a, a + width))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def check(spark, rows, **how):
    out = sd.substring_dedup(docs_of(spark, rows), **how).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out) == Counter(expected(rows, how["width"]))
    return out


@pytest.mark.parametrize("width, gram", [(5, 2), (7, 3), (6, 6), (4, 1), (1, 1)])
def test_blocks_equal_sets_of_windows(width, gram):
    """The parse of blocks in which few words make many repeats, overlaps and boundaries."""
    rng = random.Random(width)
    for _ in range(300):
        docs = [(rng.randrange(4), [rng.choice("abc") for _ in range(rng.randrange(width, 40))]) for _ in range(6)]
        docs.sort(key=lambda d: d[0])
        seen: list[tuple] = []
        for (i, words), known in zip(docs, sd.parsed_block(docs, width)):
            windows = [tuple(words[a : a + width]) for a in range(len(words) - width + 1)]
            assert known.tolist() == [any(w == x and j < i for j, x in seen) for w in windows]
            seen += [(i, w) for w in windows]


def test_factors_are_the_longest():
    rng = random.Random(4)
    for _ in range(100):
        texts, words = [[rng.choice("abcd") for _ in range(30)] for _ in range(3)], [rng.choice("abcde") for _ in range(40)]
        index = sd.Reference()
        for t in texts:
            index.add(t)
        held = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
        at = 0
        for start, length in index.factors(words):
            assert start == at and (length == 0 or tuple(words[start : start + length]) in held)
            assert start + length == 40 or tuple(words[start : start + length + 1]) not in held
            at = start + max(length, 1)
        assert at == 40


def test_equal_windows_have_equal_anchors_and_prints():
    rng = random.Random(2)
    words = [rng.choice("abcdef").encode() for _ in range(3000)]
    h, anchors, prints = hashed(words), {}, {}
    first, windows, anchor = sd.segments(h, 5, 2)
    assert windows.sum() == len(words) - 4 and (np.cumsum(windows) - windows == first).all() and windows.max() <= 4
    for a, n, k in zip(first.tolist(), windows.tolist(), anchor.tolist()):
        for i in range(a, a + n):
            assert anchors.setdefault(tuple(words[i : i + 5]), k) == k
    start = np.arange(len(words) - 4)
    for i, p in zip(start.tolist(), zip(*(x.tolist() for x in sd.Prints(h).of(start, start + 5)))):
        assert prints.setdefault(tuple(words[i : i + 5]), p) == p
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("block_rows", [256, 1])
def test_documents_of_few_words(spark, block_rows):
    """Every block is split by windows where block_rows is 1."""
    rng = random.Random(9)
    rows = [(rng.randrange(60), " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for _ in range(120)]
    check(spark, rows, width=6, gram=3, block_rows=block_rows)


@pytest.mark.parametrize("block_rows", [256, 2])
def test_passages_copies_and_odd_rows(spark, block_rows):
    rng = random.Random(5)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, edge, copy, long = plain(63), plain(50), plain(200), plain(60_000)
    rows = [(i, f"{plain(rng.randrange(0, 70))}\n{passage}\t{plain(rng.randrange(0, 70))}") for i in range(40)]
    rows += [(100 + i, copy) for i in range(30)] + [(50, f"{edge} {plain(3)}"), (51, f"{plain(2)} {edge}"), (52, f"{edge} {edge}"), (53, f"{edge[: edge.rfind(' ')]}")]
    rows += [(60, long), (61, long + " end"), (62, plain(10) + " " + long[5000:9000]), (70, None), (71, ""), (72, " \n\t "), (None, copy), (None, copy), (None, None), (73, copy + " x"), (73, copy + " x"), (73, passage), (74, " ".join(["same"] * 400)), (75, " ".join(["same"] * 51))]
    rows += [(99, copy.upper()), (98, copy.replace(" ", "\x0b\x0c ")), (97, copy.replace(" ", " "))]
    out = check(spark, rows, width=50, block_rows=block_rows)
    assert sum(r["n_removed"] >= 63 for r in out if r["doc_id"] is not None and r["doc_id"] < 40) >= 38
    assert next(r["n_removed"] for r in out if r["doc_id"] == 61) == 60_000
    assert {r["n_removed"] for r in out if r["doc_id"] is None} == {0}


@pytest.mark.parametrize("width, gram, size", [(50, 8, 11), (50, 8, 3), (50, 8, 1), (5, 2, 1), (6, 6, 1), (7, 1, 2)])
def test_equal_windows_have_equal_blocks_of_parts(width, gram, size):
    """Parts hold each window of a segment once, and an equal window of another segment has the same block."""
    rng, blocks = random.Random(size), {}
    shared = [rng.choice("abcdefghij").encode() for _ in range(width + 20)]
    for _ in range(60):
        words = [rng.choice("abcdefghij").encode() for _ in range(30)] + shared[rng.randrange(20) :] + [rng.choice("abcdefghij").encode() for _ in range(30)]
        h = hashed(words)
        for a, n, _ in zip(*(x.tolist() for x in sd.segments(h, width, gram))):
            made = sd.parts(h[a : a + n + width - 1], width, gram, size)
            assert [i for low, windows, *_ in made for i in range(low, low + windows)] == list(range(n)) and len(made) <= -(-(width - gram + 1) // size)
            for low, windows, block, *_ in made:
                for i in range(a + low, a + low + windows):
                    assert blocks.setdefault(tuple(words[i : i + width]), block) == block


@pytest.mark.parametrize("block_rows", [1, 3, 256])
def test_near_copies_in_heavy_blocks(spark, block_rows):
    """Several levels of parts: copies with changed words, parts that a document has twice, rows that repeat a doc_id."""
    rng = random.Random(12)
    plain = lambda n: [rng.choice("abcdefghij") for _ in range(n)]
    base, rows = plain(90), []
    for i in range(60):
        words = [w if rng.random() > 0.03 else rng.choice("xyz") for w in base]
        rows.append((rng.randrange(50), " ".join(plain(rng.randrange(9)) + words + (words[20:60] if i % 7 == 0 else []) + plain(rng.randrange(9)))))
    check(spark, rows, width=20, gram=3, block_rows=block_rows)


def test_a_common_line_makes_few_rows(spark, monkeypatch):
    """Documents that share a line and nothing else: the classes of its block are cut into a few parts, not into their windows."""
    made, real = Counter(), sd.staged

    def counted(df, name="table"):
        out = real(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(sd, "staged", counted)
    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line = plain(30)
    out = check(spark, [(i, f"{plain(60)} {line} {plain(60)}") for i in range(80)], width=50, block_rows=8)
    assert sum(r["n_removed"] for r in out) == 0 and made["words"] >= 80
    assert sum(n for name, n in made.items() if name not in ("segments", "classes", "copied", "blocks", "words", "spans")) <= 12 * made["words"]
    assert max(n for name, n in made.items() if name not in ("segments", "classes")) <= (sd.PARTS + 1) * made["words"]


def test_no_rows_and_bad_anchor(spark):
    assert sd.substring_dedup(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in sd.substring_dedup(docs_of(spark, [(None, None)])).collect()] == [(None, 0, 0, "")]
    with pytest.raises(ValueError):
        sd.substring_dedup(docs_of(spark, []), width=5, gram=6)
