"""The file list, page by page, against loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from lettermill.operators import files, redaction


def test_pages_of_files(spark):
    rng = random.Random(2)
    mails = [(i, None if rng.random() < 0.2 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(9)), rng.choice(["a@x", "b@x", None]), rng.choice(["t1", "t2", None])) for i in range(40)]
    bridge = sorted({(rng.randrange(40), f"s{rng.randrange(9)}") for _ in range(70)})
    bridge = [(i, s, rng.choice(["plan_v1.pdf", "plan_v2.pdf", "note.txt", "", None])) for i, s in bridge]
    kinds = {f"s{k}": ("application/pdf", "text/plain", None)[k % 3] for k in range(8)}
    status = {"s0": "extracted", "s1": "failed", "s3": "extracted"}
    frames = (
        spark.createDataFrame(bridge, "email_id long, sha256 string, filename string"), spark.createDataFrame(list(kinds.items()), "sha256 string, content_type string"),
        spark.createDataFrame(list(status.items()), "sha256 string, status string"), spark.createDataFrame(mails, "id long, date timestamp, sender_address string, thread_id string"),
    )
    of, stem = {m[0]: m for m in mails}, {"plan_v1.pdf": "plan", "plan_v2.pdf": "plan", "note.txt": "note", "": "", None: ""}

    def kin(row):
        _, _, sender, thread = of[row[0]]
        near = [r for r in bridge if stem[row[2]] and stem[r[2]] == stem[row[2]] and ((sender and of[r[0]][2] == sender) or (thread and of[r[0]][3] == thread))]
        return len({r[:2] for r in near} | {row[:2]})

    key = lambda r: (of[r[0]][1] is None, -(of[r[0]][1] or datetime(2000, 1, 1)).timestamp(), -r[0], r[1])
    for how, keep in (({}, lambda r: True), ({"family": "pdf"}, lambda r: kinds.get(r[1]) == "application/pdf"), ({"status": "pending", "scope": F.col("sender_address") == "a@x"}, lambda r: r[1] not in status and of[r[0]][2] == "a@x"), ({"filename": "PLAN"}, lambda r: "plan" in (r[2] or ""))):
        want = [(r[0], r[1], status.get(r[1], "pending"), len({x[0] for x in bridge if x[1] == r[1]}), kin(r)) for r in sorted(filter(keep, bridge), key=key)]
        got, cursor = [], None
        while part := files.page(*frames, **how, after=cursor, limit=17).collect():
            got += [(r["email_id"], r["sha256"], r["status"], r["duplicates"], r["family_count"]) for r in part]
            cursor = (part[-1]["date"], part[-1]["email_id"], part[-1]["sha256"])
        assert got == want


def test_few_texts_at_a_time(spark, monkeypatch):
    """Differences and cleaned pages leave a task in small pieces, as many rows as came."""
    monkeypatch.setattr(files, "PAIRS", 7)
    monkeypatch.setattr(redaction, "PAGES", 7)
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, ddl: seen.append(f) or self)
    rows = spark.range(1).selectExpr("id AS key", "'a' AS old", "'b' AS new", "'<p>x</p>' AS html")
    files.line_diff(rows)
    redaction.cleaned(rows.select("key", "html"))
    batch = pa.RecordBatch.from_pydict({"key": list(range(40)), "old": ["a\nb", None] * 20, "new": ["a\nc", "d"] * 20})
    diffs = list(seen[0](iter([batch])))
    pages = list(seen[1](iter([pa.RecordBatch.from_pydict({"key": list(range(40)), "html": ["<p>x</p>", None] * 20})])))
    for out in (diffs, pages):
        assert max(len(b) for b in out) == 7 and [k for b in out for k in b.column(0).to_pylist()] == list(range(40))
    assert diffs[0].to_pylist()[0]["hunks"][0]["lines"][1:] == [{"kind": "del", "text": "b"}, {"kind": "add", "text": "c"}]
    assert pages[0].to_pylist()[:2] == [{"key": 0, "html": "<p>x</p>", "clean": "<p>x</p>", "plain": "x"}, {"key": 1, "html": None, "clean": "", "plain": ""}]
