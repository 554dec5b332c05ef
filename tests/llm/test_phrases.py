"""Operator 13 against counted n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    clashes = {c: F.lit("clash") for c in ("p", "f", "a", "n", "rank", "phrase", "w1", "key", "word", "h")}
    return spark.createDataFrame(rows, "text string, lang string").repartition(4).withColumns(clashes)


def expected(rows, min_count, max_words=4, nested=80, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, max_words + 1):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= nested * f[lang, p[i:j]]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    ranks: Counter = Counter()
    for lang, score, a, phrase, one, two in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], phrase.decode(), -a, one, two, total[lang], -score


def check(spark, rows, min_count, **how):
    out = phrases.phrase_collocations(docs_of(spark, rows), min_count=min_count, **how).collect()
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in sorted(out, key=lambda r: (r["lang"], r["rank"]))]
    limits = {k: how[k] for k in ("max_words", "top") if k in how}
    assert got == sorted(expected(rows, min_count, nested=how.get("nested_percent", 80), **limits), key=lambda r: r[:2])
    return got


def made(seed: int, n: int, langs=("en", "de", None)):
    """Texts of few words: many repeats, overlaps and ties."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "b", "München", "münchen", "x\x01", "日本", "-", "one", "two"]
    for _ in range(n):
        yield "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", "!? "]) for _ in range(rng.randrange(0, 60))), rng.choice(langs)


ODD = [(None, "en"), ("", "en"), (" \t ", "fr"), ("...!?\n", "it"), ("the of the of the of the of", None), ("the of the of", "und"), ("one two " * 9_000, "en"), ("same " * 3_000, "de"), ("solo", "xx")]


@pytest.mark.parametrize("how", [{}, {"group_rows": 16, "block_words": 50}, {"filter_bits": 1 << 15, "block_words": 1}, {"max_words": 2, "top": 3}, {"max_words": 6, "group_rows": 16}, {"nested_percent": 50}])
def test_equals_counted_phrases(spark, how):
    got = check(spark, [*made(1, 200), *ODD], 30, **how)
    assert {r[0] for r in got} == {"en", "de", "und"} and len(got) > ("top" not in how) * 8


@pytest.mark.parametrize("seed", [2, 3])
def test_few_rows_and_low_counts(spark, seed):
    check(spark, list(made(seed, 12)), 2, group_rows=16, block_words=20)
    check(spark, list(made(seed, 3)), 1)


def test_no_rows(spark):
    for rows in ([], [(None, None)], [("", "en")], [("alone", "en")], [("nothing here repeats itself", "en")]):
        assert check(spark, rows, 30) == []
    with pytest.raises(ValueError):
        phrases.phrase_collocations(docs_of(spark, []), max_words=1)


def test_scores_are_exact_past_64_bits(spark):
    a = [(3 * 10**15 + 7, 4 * 10**15 + 1, 5 * 10**15 + 3), (9 * 10**16, 9 * 10**16, 9 * 10**16), (30, 10**17, 10**17 + 1)]
    rows = spark.createDataFrame(a, "a long, l long, r long")
    whole = F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")
    got = [r[0] for r in rows.select(phrases._share(F.col("a"), whole, 2_000_000)).collect()]
    assert got == [2_000_000 * x // (y + z) for x, y, z in a]


def test_filters_hold_all_their_keys(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5_000, dtype=np.int64)
    made = phrases.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"), 1 << 20)
    others = rng.integers(-(2**63), 2**63 - 1, 50_000, dtype=np.int64)
    assert made.has(keys.view(np.uint64)).all() and made.has(others.view(np.uint64)).mean() < 0.03
    assert made.bits == 1 << 17 and not phrases.Filter.of(spark.createDataFrame([], "key long"), 1 << 20).has(keys.view(np.uint64)).any()


def test_distinct_rows_packed_or_sorted():
    rng = np.random.default_rng(2)
    for wide in (1, 1 << 30):
        columns = [rng.integers(-1, 4, 500) * wide for _ in range(4)]
        columns = [np.where(c < 0, -1, c) for c in columns]
        found, counts = phrases._distinct(columns)
        assert Counter(dict(zip(zip(*(c.tolist() for c in found)), counts.tolist()))) == Counter(zip(*(c.tolist() for c in columns)))
    found, counts = phrases._distinct([np.empty(0, np.int32)] * 5)
    assert [len(c) for c in found] == [0] * 5 and not len(counts)


def test_no_group_holds_a_frequent_word(spark):
    """Half of all suffixes begin with one word: its prefixes are extended, and no task gets them all."""
    rng = random.Random(8)
    rows = [(" ".join(w for _ in range(60) for w in ("the", f"w{rng.randrange(9)}")), "en") for _ in range(400)]
    texts = docs_of(spark, rows).select("lang", "text")
    check(spark, rows, 30, group_rows=160, block_words=300)
    w = ["w1", "w2", "w3", "w4"]
    schema = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in w), ("c", pa.int64()), ("word", pa.string())])
    everything = phrases.Filter(1 << 15, np.full(4096, 255, np.uint8))
    rows = phrases._counted(texts, phrases._suffix_rows(everything, everything, 4), "lang string, w1 long, w2 long, w3 long, w4 long, c long, word string", schema, 300)
    suffixes = rows.filter("w2 is not null").drop("word").cache()
    extended = phrases._extended(suffixes, w, suffixes.count() // 20)
    assert [e.count() for e in extended][0] >= 1
    dealt = phrases._grouped(suffixes, w, extended, 16).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.35 * suffixes.count()


@pytest.mark.parametrize("block_words, stretch", [(1, 1), (7, 3), (40, 16), (10**6, 1 << 20)])
def test_blocks_keep_pieces_whole(block_words, stretch):
    """Long texts go through in stretches; pieces that go on over a stretch or a block stay whole."""
    rows = [*made(4, 40), ("one piece " * 60, "en"), ("x" * 500, "en"), ("", "de"), ("a,b;c\td", "de")]
    batch = pa.RecordBatch.from_pydict({"lang": [x or "und" for _, x in rows], "text": [t for t, _ in rows]})
    got = []
    for b in phrases.blocks(iter([batch]), block_words, stretch):
        starts = np.flatnonzero(np.concatenate([[True], b.rest[1:] != b.rest[:-1] - 1])) if len(b.rest) else []
        got += [(b.names[b.lang[i]], [b.words[k] for k in b.ids[i : i + b.rest[i]]]) for i in starts]
    want = [(x or "und", p.encode().split()) for t, x in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)) if p.encode().split()]
    assert got == want
