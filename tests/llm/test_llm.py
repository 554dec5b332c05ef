"""The training-data operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import bpe, chat, decontamination, language, licenses, line_dedup, near_dup, quality_model, quality_rules, queries, toxicity
from lettermill.llm.words import shingles, split_words

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Rows with columns that clash with the operators' own names."""
    return spark.createDataFrame(rows, DOC).withColumns({"kept": F.lit(1), "lines": F.lit("x"), "id": F.lit(2), "component": F.lit(3), "n": F.lit(0), "score": F.lit("s")})


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# 1
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_library(spark, tokenizer):
    rng = random.Random(1)
    texts = [
        "a" * 5000, "ab" * 3000, " " * 4000 + "x", "x" * 300 + "'s" + "!" * 4000 + "'s" + "é" * 3000, "".join(rng.choice("ab'") for _ in range(6000)), "".join(rng.choice("aB3-é 'st") for _ in range(6000)),
        "word " * 2000 + "<|endoftext|>" * 300 + "zz", "".join(rng.choice("the in") for _ in range(9000)), "日本" * 2000 + "\n" * 3000 + "1" * 2000, "".join(rng.choice("  \n\tx") for _ in range(5000)), "", None,
    ]
    rows = [*enumerate(texts), (None, "abc"), (0, texts[0]), (None, None)]
    for size in (60, 700, 10**6):
        out = bpe.encode(docs_of(spark, rows), queries.vocabulary(), piece_chars=size, with_text=True).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] is None:
                continue
            t = texts[r["doc_id"]] or ""
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids and r["text"] == t
    again = bpe.decode(bpe.encode(docs_of(spark, rows), queries.vocabulary()), queries.vocabulary(), "n_tokens").collect()
    assert Counter(r["text"] for r in again) == Counter((t or "") for _, t in rows)
    assert bpe.encode(docs_of(spark, []), queries.vocabulary()).count() == 0


def test_bpe_of_spaces_at_pack_ends(spark, tokenizer):
    """CRLF, tabs and ideographic spaces where packs of pre-tokens end."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(["漢字" * rng.randrange(1, 9), "\r\n\r\n", "\t\t", "\u3000\u3000", "\r\n", "a\u3000"]) for _ in range(400)) for _ in range(6)]
    for r in bpe.encode(docs_of(spark, list(enumerate(texts))), queries.vocabulary(), piece_chars=50).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_seam_joins(tokenizer):
    coder, rng = bpe.Vocabulary(queries.vocabulary()).encoding(), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 90)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [coder._encode_single_piece(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)]) if b > a]
        assert bpe.tree(parts, coder) == tokenizer.encode(text, add_special_tokens=False).ids


# 2
def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  COMMON line \nÉtat\n") for i in range(9)] + [(9, "common LINE"), (10, None), (11, ""), (9, "common LINE"), (None, "x\ncommon line")]
    out = line_dedup.line_dedup(docs_of(spark, rows), min_docs=10).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[0] == [("own 0\nÉtat\n", 4, 1)] and by[9] == [("", 1, 1)] * 2 and by[10] == by[11] == [("", 1, 0)] and by[None] == [("x", 2, 1)]
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_identity(spark):
    """A doc_id counts once whatever its texts, rows without one count as no document; as the oracle has it."""
    rows = [(i, "shared\nown") for i in range(8)] + [(None, "shared"), (8, "shared\na"), (8, "shared\nb")]
    out = line_dedup.line_dedup(docs_of(spark, rows), min_docs=10).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_dropped"]) for r in out) == sorted((d is None, d or 0, 0) for d, _ in rows)
    out = line_dedup.line_dedup(docs_of(spark, [*rows, (9, "SHARED")]), min_docs=10).collect()
    assert all(r["n_dropped"] == 1 and "shared" not in r["text"] for r in out)
    many = [(i, "\n".join(f"{i} {k}" for k in range(40)) + "\nhot") for i in range(60)] + [(99, "long\n" * 20000)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs_of(spark, many), min_docs=10).collect()}
    assert out == {i: 1 for i in range(60)} | {99: 0}


def test_line_dedup_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op2_line_dedup"]).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert got == want


# 3
def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/y.py", ""), ("a/b/c/z.py", "one\n# Licensed under the Apache License, Version 2.0.\ntwo"),
        ("top.py", None), ("q/r.py", "we licensed nothing here but tried a lot of other words"), (None, "Released under the MIT License."), ("a/b/x.py", "code"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumns({"dir": F.lit(1), "license_id": F.lit("no")})
    out = licenses.license_scan(df).collect()
    by = {r["path"]: (r["license_id"], r["how"], r["from_dir"]) for r in out}
    assert len(out) == len(files)
    assert by["a/b/x.py"] == ("MIT", "inherited", "a") and by["a/b/c/d/y.py"] == ("GPL-3.0", "inherited", "a/b/c") and by["a/b/c/z.py"] == ("Apache-2.0", "own", None)
    assert by["top.py"] == by["q/r.py"] == by[None] == (None, None, None)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_licenses_of_wrapped_headers(spark):
    """Standard notices as files carry them: wrapped, as comments, with lines before and after."""
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    notices = {
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "LGPL-2.1": lgpl.format("2.1"), "LGPL-3.0": lgpl.format("3"), "GPL-3.0": lgpl.format("3").replace("library", "program").replace("Lesser ", ""),
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    }
    files, want = [], {}
    for width in (40, 55, 72):
        for name, notice in notices.items():
            for mark in ("# ", " * ", ""):
                path = f"{len(files)}/a.c"
                files.append((path, "\n".join(["int main;", "", *(mark + x for x in textwrap.wrap(notice, width)), "", "more code here", "and there"])))
                want[path] = name
    files += [("mpl/LICENSE", files[0][1]), ("mpl/src/x.c", "code")]
    out = {r["path"]: (r["license_id"], r["how"]) for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: out[p] for p in want} == {p: (v, "own") for p, v in want.items()}
    assert out["mpl/src/x.c"] == ("MPL-2.0", "inherited")


def test_licenses_find_every_notice(spark, sf_dir):
    out = queries.op3_licenses(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    notice = F.lower("text").contains("licensed under") | F.lower("text").contains("released under the mit")
    assert {r["doc_id"] for r in out.filter("how = 'own'").collect()} == {r["doc_id"] for r in docs.filter(notice).collect()}


def test_licenses_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    rel = con.execute(queries.ORACLE_SQL["op3_licenses"])
    names = [d[0] for d in rel.description]
    want = {r[names.index("doc_id")]: {n: v for n, v in zip(names, r)} for r in rel.fetchall()}
    got = {r["doc_id"]: r.asDict() for r in queries.op3_licenses(spark, sf_dir).collect()}
    assert got == want and any(r["how"] == "own" for r in got.values())


def test_licenses_of_whole_texts(spark):
    """Whole licence texts where the machine has them, and short ones by hand; a version decides."""
    from pathlib import Path

    here = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    texts = {v: p.read_text() for k, v in here.items() if (p := Path("/usr/share/common-licenses") / k).exists()}
    text = dict(licenses.TEMPLATES)
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib"):
        texts[name] = f"{name} License\n\nCopyright (c) 2020, Someone Else\n\n" + textwrap.fill(text[name], 70) + "\n\nIN NO EVENT SHALL THEY BE LIABLE FOR ANY DAMAGES.\n"
    files = [(f"{k}/LICENSE", t) for k, t in texts.items()]
    files += [(f"long/{k}.c", "word line\n" * 3000 + t + "other words\n" * 3000) for k, t in list(texts.items())[-3:]]
    out = {r["path"]: r["license_id"] for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert out == {p: p.split("/")[-1].removesuffix(".c") if p.startswith("long") else p.split("/")[0] for p, _ in files}
    assert {r["license_id"] for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string"), licenses.default_templates(spark).limit(0)).collect()} == {None}


def test_licenses_against_all_windows(spark):
    """Fifty files by brute force: windows at every place of every heavy term, without the first bound."""
    rng = random.Random(3)
    words = lambda t: re.findall(licenses.TERM, t.lower())
    fill = [w for _, t in licenses.TEMPLATES for w in words(t)] + ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(400)]
    files = []
    for i in range(50):
        body = [rng.choice(fill) for _ in range(rng.randrange(5, 120))]
        if i % 2:
            notice = words(rng.choice(licenses.TEMPLATES)[1])
            at = rng.randrange(len(body))
            body[at:at] = [w for w in notice if rng.random() > 0.1 * (i % 3)]
        files.append((f"f{i}", " ".join(body)))
    n, sets = len(files), [set(words(t)) for _, t in files]
    want = {}
    for path, t in files:
        w, best = words(t), []
        for name, template in licenses.TEMPLATES:
            v = words(template)
            idf = {x: np.log((1 + n) / (1 + sum(x in s for s in sets))) + 1 for x in v}
            u = {x: (1 + np.log(v.count(x))) * idf[x] for x in idf}
            size = np.sqrt(sum(x * x for x in u.values()))
            heavy, left = [], 1.0
            for x in sorted(u, key=lambda x: (-u[x], x)):
                if left >= 0.36 - 1e-12:
                    heavy.append(x)
                left -= (u[x] / size) ** 2
            for x in heavy:
                for i in (i for i, y in enumerate(w) if y == x):
                    a = i - v.index(x)
                    c = Counter(w[max(a, 0) : a + len(v)])
                    dot = sum((1 + np.log(k)) * idf[y] * u[y] / size for y, k in c.items() if y in u)
                    square = sum(((1 + np.log(k)) * idf[y]) ** 2 if y in u else k for y, k in c.items())
                    best.append((round(float(dot / np.sqrt(square)), 9), len(v), name))
        best = max(best, default=(0, 0, None))
        want[path] = (best[2], best[0]) if best[0] >= 0.6 else (None, None)
    got = {r["path"]: (r["license_id"], r["cosine"]) for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()} and sum(v[0] is not None for v in want.values()) > 20
    assert all(v[1] is None or abs(v[1] - got[p][1]) < 1e-8 for p, v in want.items())


# 4
def test_chat(spark):
    rng = random.Random(4)
    bits = ["<|", "|>", "\\", "<", "|", "\n", "<|im_start|>", "<|im_end|>", "a", "é", "<\\n|", ""]
    rows = [(5, i, rng.choice(["user", "assistant", "assistant", "system", "to\nol"]), "".join(rng.choice(bits) for _ in range(rng.randrange(200)))) for i in range(700)]
    rows += [(6, 1, "user", "x" * 20000), (6, 2, None, None), (6, 2, None, None), (None, None, "assistant", "q"), (6, 3, "assistant", "y" * 9000), (7, 0, "system", "rules"), (7, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"span": F.lit(1), "tokens": F.lit("t"), "key": F.lit(0)})
    for budget in (200, 2048):
        w = chat.chat_windows(df, budget=budget, history=64).cache()
        by: dict = {}
        for r in rows:
            by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for r in chat.chat_digests(w).collect():
            turns = sorted(by[r["conv_id"]])
            lost = "".join(t[3] for t in turns if t[2] == "assistant")
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(lost), digest(lost))
        assert all(r["n_turns"] == 1 for r in w.filter("over_budget").collect())
        assert chat.read_turns(w).select(F.sum(F.size("turns"))).first()[0] == len(rows)
        assert chat.read_loss(w).select(F.sum(F.size("targets"))).first()[0] == sum(1 for r in rows if r[2] == "assistant")
    assert chat.chat_digests(chat.chat_windows(df.limit(0))).count() == 0


def windows_of(turns, budget, history):
    """Brute force over one conversation's turns (role, text) in order: (context, own) index lists of each window."""
    size = [-(-(len(r.encode()) + len(t.encode())) // 4) + 4 for r, t in turns]
    system = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    half = max(1, max(1, budget - history - (size[system] if system is not None else 0)) // 2)
    at = [sum(size[:i]) for i in range(len(turns))]
    spans: dict = {}
    for i in range(len(turns)):
        spans.setdefault((at[i] // half, 2 * sum(n > half for n in size[:i]) + (size[i] > half)), []).append(i)
    for own in spans.values():
        rule = [system] if system is not None and system < own[0] else []
        yield rule + [i for i in range(own[0]) if [i] != rule and at[own[0]] - at[i] <= history], own


def test_chat_windows_equal_brute_force_over_blocks(spark):
    rng = random.Random(9)
    talks = {c: [(rng.choice(["user", "assistant", "system"]) if i > 3 else "user", "w" * rng.choice([0, 3, 40, 200, 1500])) for i in range(n)] for c, n in ((0, 300), (1, 1), (2, 40))}
    talks[2] = [("user", t) for _, t in talks[2]]
    df = spark.createDataFrame([(c or None, 3 * i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    say = lambda turns, part: "".join(f"<|im_start|>{turns[i][0]}\n{turns[i][1]}<|im_end|>\n" for i in part)
    for budget, history in ((400, 100), (900, 0)):
        expected = sorted((c, say(turns, context + own), len(context), len(own)) for c, turns in talks.items() for context, own in windows_of(turns, budget, history))
        for block_turns in (7, 256):
            w = chat.chat_windows(df, budget=budget, history=history, block_turns=block_turns).collect()
            assert sorted((r["conv_id"] or 0, r["text"], r["n_context"], r["n_turns"]) for r in w) == expected


# 5, 6
def count_all(t):
    words = WORD.findall(t)
    c = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in t), dup, len(covered)


def test_quality_rules(spark, documents, labels):
    extra = docs_of(spark, [(-1, None), (-2, ""), (-3, "a b c a b c\n x\n\x1cy"), (None, "word " * 60), (-3, "z")]).select("doc_id", "text")
    both = documents.select("doc_id", "text").unionByName(extra)
    out = quality_rules.quality_rules(both).collect()
    texts = Counter((r["doc_id"], count_all(r["text"] or "")) for r in both.collect())
    assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in out) == texts
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in out) and not any(r["kept"] for r in out if r["base_failed"])
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["kept"], marks[r["doc_id"]]) for r in out if r["doc_id"] in marks and not r["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    assert quality_rules.quality_rules(documents.limit(0)).count() == 0


def test_votes_recover_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 6)) < np.where(good, 0.05, 0.7)[:, None], -1, np.where(rng.random((4000, 6)) < 0.2, 0, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_votes(patterns, counts.astype(float))
    odds = model.prior + sum(np.array(w)[votes[:, i] + 1] for i, w in enumerate(model.votes))
    assert np.mean((odds > 0) == good) > 0.97


def held(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def test_quality_model(spark, documents, labels):
    out = quality_model.quality_scores(documents.unionByName(docs_of(spark, [(None, None), (-1, "")]).select("doc_id", "text"), allowMissingColumns=True), labels).collect()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(out) == documents.count() + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in out if r["doc_id"] is not None)
    test = [(r["predicted"], marks[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([p == y for p, y in test]) > 0.85
    assert {r["score"] for r in quality_model.quality_scores(documents.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(documents.limit(0), labels).count() == 0


def test_isotonic():
    x, y = quality_model.isotonic(np.arange(6.0), np.array([0, 0.5, 0.25, 0.75, 0.5, 1]), np.ones(6))
    assert (np.diff(y) >= 0).all() and y[2] == pytest.approx(0.375) and len(x) == len(y)


# 7
def test_language(spark, documents):
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "12 34!", "en"), (None, "the and of", None), (-3, "", None)], "doc_id long, text string, lang string")
    out = language.language_id(documents.select("doc_id", "text", "lang").unionByName(extra)).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" for i in (-1, -2, -3)) and by[None]["lang_pred"] == "en"
    test = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert test and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in test]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in language.language_id(documents.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()} == {"und"}
    assert language.language_id(documents.limit(0)).count() == 0


def test_language_learns_from_no_row_without_id(spark, documents):
    """Rows with a null doc_id change no score, whatever they say."""
    some = documents.select("doc_id", "text", "lang")
    noise = spark.createDataFrame([(None, "zzz qqq xxx " * 50, "xx")] * 40, "doc_id long, text string, lang string")
    score = lambda d: {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.language_id(d).filter("doc_id is not null").collect()}
    assert score(some) == score(some.unionByName(noise))


def test_language_vectors_and_chances():
    """TF-IDF vectors and softmax of a model by plain loops."""
    bits, rng = 10, np.random.default_rng(2)
    m = language.LanguageModel(["a", "b", "c"], rng.random(1 << bits).astype(np.float32) + 1, rng.normal(size=(1 << bits, 3)).astype(np.float32), 1.7, bits)
    text = "Größe, ab 12!"
    points = [32, *map(ord, "größe ab ")]
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            code = (n << 60) * (n < 3) + sum(p << (21 * j) for j, p in enumerate(points[i : i + n]))
            counts[(code % 2**64) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits)] += 1
    x = {k: (1 + np.log(v)) * m.idf[k] for k, v in counts.items()}
    size = np.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / size * m.weights[k, j] for k, v in x.items()) / 1.7 for j in range(3)]
    p = np.exp(z) / np.exp(z).sum()
    name, score = m.predict(text)
    assert name == "abc"[int(p.argmax())] and score == pytest.approx(p.max(), rel=1e-4)


# 8
def test_decontamination(spark):
    rng = random.Random(8)
    vocab = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)] + ["the", "of", "and"] * 300
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.randrange(15, 60)) for _ in range(40)]
    rows, want = [(i, " ".join(say(rng.randrange(0, 400)))) for i in range(150)], set()
    for k, item in enumerate(items):
        host = say(rng.randrange(0, 500))
        at = rng.randrange(len(host) + 1)
        said = [w.upper() + "," if rng.random() < 0.3 else w for w in item]
        if k % 2:
            said = [f"x{i}" if i % 9 == 4 else w for i, w in enumerate(said)]  # a paraphrase
        rows.append((1000 + k, " ".join(host[:at] + said + host[at:])))
        want.add((1000 + k, k))
    rows += [(2000, None), (2001, ""), (None, " ".join(items[0])), (1000, rows[150][1])]
    bench = spark.createDataFrame([*((k, " ".join(i), "free") for k, i in enumerate(items)), (98, None, None), (99, "", None)], "item_id long, text string, words string")
    out = decontamination.benchmark_leaks(docs_of(spark, rows), bench).collect()
    got = [(r["doc_id"], r["item_id"]) for r in out]
    assert len(got) == len(set(got)) and set(got) - {(None, 0)} <= want and (None, 0) in got
    assert len(set(got) & want) >= 0.9 * len(want) and {(d, k) for d, k in want if k % 2 == 0} <= set(got)
    answered = bench.withColumn("answer", F.when(F.col("item_id") == 0, "never said words").otherwise(F.lit(None)))
    assert (1000, 0) not in {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_leaks(docs_of(spark, rows), answered, answer="answer", block_items=15).collect()}
    assert decontamination.benchmark_leaks(docs_of(spark, []), bench).count() == 0 and decontamination.benchmark_leaks(docs_of(spark, rows[:3]), bench.limit(0)).count() == 0


def test_decontamination_more_passages_than_dimensions(spark):
    """On sf0.1 (200 items, 376 passages, 96 dimensions): all items that a window holds by brute force, whole ones among them."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_leaks(docs, bench).collect()}
    items = [(r["item_id"], decontamination.word_hashes(r["text"].encode())) for r in bench.collect()]
    known = np.unique(np.concatenate([w for _, w in items]))
    member = np.array([np.isin(known, w) for _, w in items] + [np.zeros(len(known), bool)]).T[:, :-1]
    want, whole = set(), set()
    for r in docs.select("doc_id", "text").collect():
        words = decontamination.word_hashes((r["text"] or "").encode())
        if not len(words):
            continue
        slot = np.minimum(np.searchsorted(known, words), len(known) - 1)
        held = np.cumsum(np.vstack([np.zeros(len(items), np.int32), member[slot] & (known[slot] == words)[:, None]]), axis=0, dtype=np.int32)
        starts = np.arange(0, len(words), 16)
        for k, (item, said) in enumerate(items):
            n = len(said)
            most = held[np.minimum(starts + n + 16, len(words)), k] - held[starts, k]
            for at in starts[most >= 0.75 * n].tolist():
                same = decontamination.common_subsequence(said, words[at : at + n + 16])
                if same >= 0.75 * n:
                    want.add((r["doc_id"], item))
                if same == n and said.tobytes() in words[at : at + n + 16].tobytes():
                    whole.add((r["doc_id"], item))
    latent = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_leaks(docs, bench, rare_words=False).collect()}
    print(f"whole {len(whole & found)} of {len(whole)}, brute force {len(want & found)} of {len(want)}, found {len(found)}, by the latent search alone {len(want & latent)}")
    assert len(whole) > 200 and whole <= found and len(want & found) >= 0.99 * len(want)
    assert latent <= found and len(want & latent) >= 0.95 * len(want)


def test_latent_search_of_paraphrases(spark):
    """400 items (over four times the passages of the basis) planted with 15 % of the words exchanged and some dropped, without rare words."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("na", "ter", "lo", "mis", "ra", "den", "ku", "sil")]
    said = lambda n: [rng.choices(vocabulary, range(len(vocabulary), 0, -1))[0] for _ in range(n)]
    items = [said(rng.randrange(20, 60)) for _ in range(400)]
    rows = []
    for i, words in enumerate(items):
        changed = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in words if rng.random() > 0.05]
        rows.append((i, " ".join(said(rng.randrange(0, 90)) + changed + said(rng.randrange(0, 90)))))
    rows += [(1000 + i, " ".join(said(120))) for i in range(300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_leaks(docs_of(spark, rows), bench, rare_words=False).collect()}
    hashes = [decontamination.word_hashes(" ".join(w).encode()) for w in items]
    want = {(i, i) for i in range(400) if decontamination.common_subsequence(hashes[i], decontamination.word_hashes(rows[i][1].encode())) >= 0.75 * len(hashes[i])}
    print(f"paraphrases {len(got & want)} of {len(want)}, found {len(got)}")
    assert len(want) > 250 and len(got & want) >= 0.9 * len(want) and not any(d >= 1000 for d, _ in got)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        assert decontamination.common_subsequence(np.array(a, np.uint32), np.array(b, np.uint32)) == row[-1]


# 9
def test_toxicity_scores_by_pairs():
    """The machine's odds against a sum over all pairs."""
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=64), rng.normal(size=(64, 4)))
    for n in (0, 1, 2, 20):
        at = rng.permutation(64)[:n]
        pairs = sum(m.factors[i] @ m.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert m.odds(at) == pytest.approx(0.3 + m.weights[at].sum() + pairs)


def test_toxicity_learns_pairs():
    """Either word alone is toxic, both or none are not: no linear weights can tell."""
    rng, rows, y = np.random.default_rng(1), [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*[1] * int(a), *[2] * int(b), *rng.integers(10, 60, 5).tolist()})))
        y.append(float(a != b))
    m = toxicity.fit_machine(rows, np.array(y), bits=6, rank=4, rate=0.1, l1=0.05, l2=1.0, epochs=8, min_rows=3, pair_share=0.2, seed=1)
    assert np.mean([(m.score(r) >= 0.5) == t for r, t in zip(rows, y)]) > 0.97


def test_toxicity(spark):
    rng = random.Random(9)
    vocab, bad = ["".join(rng.choice("aeionrst") for _ in range(5)) for _ in range(300)], ["idiot", "moron", "scum"]
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [rng.choice(vocab) for _ in range(40)] + ([*rng.sample(bad, 2)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(None, None), (-1, ""), (3, rows[3][1])]
    out = toxicity.toxicity_scores(docs_of(spark, rows), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    test = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in out if r["held_out"]]
    assert np.mean([p == t for p, t in test]) > 0.97
    assert {r["score"] for r in toxicity.toxicity_scores(docs_of(spark, rows[:4]), spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.5}


# 10
def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark):
    rng = random.Random(10)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(2000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for size, copies in ((150, 120), (40, 30), (600, 12)):  # groups with light and heavy edits, around the threshold
        base = say(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, size // 20 + 2)):
                p = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[p] = rng.choice(vocab)
                else:
                    del w[p : p + 3]
            rows.append(" ".join(w))
    rows += [" ".join(say(rng.randrange(1, 200))) for _ in range(80)] + ["one two", "One TWO", "two one", "", None, " \n", "a b c d e", "A b c d e\n"]
    rows += rows[:20]
    ids = rng.sample(range(10_000), len(rows))
    data = list(zip(ids, rows))
    out = near_dup.near_duplicates(docs_of(spark, [*data, (None, rows[0]), (None, None), data[0]])).collect()
    assert len(out) == len(data) + 3
    want = brute_components(data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None}
    assert got == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_several_texts(spark):
    """Rows that repeat a doc_id with other texts are one document, linked by each of them, in any order of the rows."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (9, "something else"), (9, a), (12, None)]
    for data in (rows, rows[::-1]):
        out = near_dup.near_duplicates(docs_of(spark, data)).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (9, 5, False), (9, 5, False), (12, 12, True)]


def test_near_duplicates_in_many_blocks(spark):
    """Members that no hub links, in one bucket of many blocks: a long chain of small changes around a common text."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(100), 2 + i % 4):
            w[p] = f"x{i}-{p}"
        rows.append((i, " ".join(w)))
    out = near_dup.near_duplicates(docs_of(spark, rows), rows=1, bands=8, block_rows=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for shared in (60, 75, 90):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (shared * 20, (100 - shared) * 10, (100 - shared) * 10))
        x, y = (near_dup.odd_sketch(near_dup.minhash(np.concatenate([common, o]), 128), 512) for o in (a, b))
        diff = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert abs(near_dup.odd_similarity(diff, 128, 512) - shared / 100) < 0.17
    assert len(shingles(split_words(b"a b c"), 5)) == 1 and len(shingles([], 5)) == 0
