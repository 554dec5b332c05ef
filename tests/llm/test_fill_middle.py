"""Operator 11 against slices of Python strings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import fill_middle, queries

ODD = [(1, ""), (2, None), (3, "x"), (4, "keep <P> plain"), (5, "a<S"), (6, "S>b<"), (None, "no id"), (None, None), (7, "twice"), (7, "twice"), (7, "other text of 7"), (8, "日本語 𝄞 é́\r\n\t  end "), (9, "<M>"), (10, "word " * 70_000)]


def docs_of(spark, rows):
    clashes = {c: F.lit("clash") for c in ("n", "h1", "form", "output", "restored", "d", "low")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashes)



def expected(doc_id, text, unit="char", marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix, middle, output) by plain slices."""
    text = text or ""
    units = re.findall({"char": r"[\s\S]", "word": r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", "line": r"[^\n]*\n|[^\n]+"}[unit], text)
    n, d = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in marks) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < 20
    out = f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}" if spm else f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"
    return n, "spm" if spm else "psm", low, high - low, out


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("block", [40, 1 << 20])
def test_equals_slices(spark, unit, block):
    rng = random.Random(3)
    made = ["".join(rng.choice("a b\nc é日𝄞 \tPSM<>") for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    rows = [*ODD[: -1 if block == 40 else None], *((100 + i, t) for i, t in enumerate(made))]
    out = fill_middle.fill_middle(docs_of(spark, rows), unit=unit, block_bytes=block, with_restored=True).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"], r["restored"]) for r in out)
    assert got == Counter((i, *expected(i, t, unit), t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_shares_marks_and_no_rows(spark):
    rows = [(i, f"text number {i} of many") for i in range(2000)]
    forms = Counter(r["form"] for r in fill_middle.fill_middle(docs_of(spark, rows)).collect())
    assert 1750 < 2000 - forms["plain"] < 1850 and 300 < forms["spm"] < 420
    own = ("[pre]", "[suffix]", "[mid]")
    for r in fill_middle.fill_middle(docs_of(spark, rows[:200]), marks=own, with_restored=True).collect():
        assert r["restored"] == rows[r["doc_id"]][1] and (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == expected(r["doc_id"], rows[r["doc_id"]][1], marks=own)
    assert fill_middle.fill_middle(docs_of(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("", "b", "c"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(docs_of(spark, []), marks=marks)


def test_pieces_of_a_long_text_in_blocks():
    text = pa.array(["ab\n日本 c\n\n" * 50], pa.large_string())
    for unit in ("char", "word", "line"):
        n = len(fill_middle.unit_lists(text, unit).values)
        for low, high in ((0, 0), (0, n), (n, n), (n // 3, n // 2), (1, n - 1)):
            units = fill_middle.unit_lists(text, unit).values.to_pylist()
            parts = [p[0].as_py() for p in fill_middle._of_long(text, low, high, unit, 32)]
            assert parts == ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]


def test_query_restores_every_text(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op11_fill_middle(spark, sf_dir).collect()
    assert len(out) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in out:
        n, form, prefix, middle, output = expected(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(texts[r["doc_id"]]))
