from __future__ import annotations

import io
import time
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettermill.operators import events, files, health, redaction, topics
from lettermill.sources import mailbox, mbox, schemas, sinks, versions
from lettermill.streaming import jobs


def burst_rows(spark, counts):
    return spark.createDataFrame([("s", d, c) for d, c in counts], "series string, day date, cnt long")


def days(start, n, cnt, **more):
    out = [(start + timedelta(days=i), cnt) for i in range(n)]
    return out + [(date.fromisoformat(k), v) for k, v in more.get("spikes", {}).items()]


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        (days(date(2020, 1, 1), 14, 10), []),
        ([(date(2020, 1, 1), 0)], []),
        (days(date(2020, 5, 1), 19, 5, spikes={"2020-06-10": 50}), [("2020-06-09", "2020-06-11")]),
        (days(date(2020, 2, 1), 19, 3, spikes={"2020-03-05": 40, "2020-03-07": 40}), [("2020-03-04", "2020-03-08")]),
        (days(date(2020, 3, 1), 24, 3, spikes={"2020-04-05": 40, "2020-04-10": 40}), [("2020-04-04", "2020-04-06"), ("2020-04-09", "2020-04-11")]),
        (days(date(2020, 4, 1), 9, 10), []),
        (days(date(2020, 4, 1), 9, 10, spikes={"2020-05-04": 25}), [("2020-05-03", "2020-05-05")]),
        (days(date(2020, 4, 1), 9, 1), []),
    ],
)
def test_bursts(spark, counts, expected):
    rows = events.bursts(burst_rows(spark, counts)).orderBy("burst_start").collect()
    assert [(str(r["burst_start"]), str(r["burst_end"])) for r in rows] == expected


def test_burst_cap(spark):
    counts = days(date(2020, 1, 1), 200, 2) + [(date(2021, 1, 1) + timedelta(days=10 * i), 50 + i) for i in range(10)]
    rows = events.bursts(burst_rows(spark, counts), max_bursts=5).orderBy("rank").collect()
    assert [r["total"] for r in rows] == [59, 58, 57, 56, 55]


STEMS = {
    "Final_Roof_Estimate_v3.pdf": "final_roof_estimate", "invoice_final.docx": "invoice", "invoice-draft.pdf": "invoice", "report copy.pdf": "report", "report (2).pdf": "report", "report(3).xlsx": "report",
    "Budget_v12_final.pdf": "budget", "UPPER_CASE_V2.PDF": "upper_case", "file-v1-copy-final.pdf": "file", "estimate_copy_2.pdf": "estimate", "roof_photos.zip": "roof_photos", "noext": "noext", "": "",
}


def test_stems_and_amounts(spark):
    df = spark.createDataFrame(list(STEMS), "string").select("value", files.filename_stem("value").alias("s"))
    assert {r["value"]: r["s"] for r in df.collect()} == STEMS
    texts = ["Total: $1,234.56", "€ 99", "£5000", "price 42", "version v3 only", "no money here"]
    n = spark.createDataFrame(texts, "string").select(F.size(files.amounts("value")).alias("n"))
    assert [r["n"] > 0 for r in n.collect()] == [True] * 5 + [False]


def test_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nline2\nc", "a\nline2 $5\nc\nline4"), (2, "x", "x"), (3, None, "")], "key int, old string, new string")
    diffs = files.line_diff(pairs)
    by = {r["key"]: r for r in diffs.collect()}
    assert {x["kind"] for h in by[1]["hunks"] for x in h["lines"]} == {"same", "add", "del"} and not by[2]["hunks"] and not by[3]["hunks"]
    assert {(r["kind"], r["text"]) for r in files.amount_changes(diffs).collect()} == {("del", "line2"), ("add", "line2 $5"), ("add", "line4")}


def test_pii():
    kinds = lambda t, **k: [(s[0], s[1]) for s in redaction.find_spans(t, **k)]
    assert kinds("mail alice@example.com now") == [("email", "alice@example.com")]
    assert kinds("call +1 (415) 555-0100") == [("phone", "+1 (415) 555-0100")]
    assert kinds("at 123 Main St") == [("street_address", "123 Main St")]
    assert kinds("acct 123456789012") == [("account_number", "123456789012")]
    assert kinds("Project Nightingale", terms=("nightingale",)) == [("custom", "Nightingale")]
    for no in ("2015", "2015-06-01", "2015/06/01", "20150601", "1234567"):
        assert not [k for k, _ in kinds(no) if k == "account_number"]


def test_redacted(spark):
    df = redaction.redacted(redaction.with_spans(spark.createDataFrame([("write a@b.co and c@d.org!",), ("none",), (None,)], "text string")))
    assert [r["redacted"] for r in df.collect()] == ["write [REDACTED:email] and [REDACTED:email]!", "none", None]


def test_chunks():
    md = "intro\n\n# A\nalpha\n## B\nbeta\n\n" + " ".join(f"w{i}." for i in range(30)) + "\n# C\ngamma"
    out = redaction.chunks_of(md, most=10, least=3)
    assert all(n <= 10 for _, _, n in out) and out[0][1].startswith("intro")
    assert "A > B" in {p for p, _, _ in out}
    words = " ".join(t for _, t, _ in out).split()
    assert words == [w for line in md.splitlines() if not line.startswith("#") for w in line.split()]
    assert redaction.chunks_of("  ") == []


def test_clean_html():
    html, text = redaction.clean_html('<p onclick="x()">Hi <a href="javascript:1" title="t">you</a><script>bad()</script><img src="x"></p>')
    assert "script" not in html and "onclick" not in html and "javascript" not in html and "img" not in html and text.split() == ["Hi", "you"]


MBOX = """From a@x Thu Jan 01 00:00:00 2025
Message-ID: <m1@x>
From: Alice <alice@x.com>
To: bob@y.com, carol@y.com
Cc: dave@y.com
Date: Thu, 02 Jan 2025 10:00:00 +0200
Subject: =?utf-8?q?Caf=C3=A9?=
X-Gmail-Labels: Inbox, Work

hello
From b@y Thu Jan 01 00:00:00 2025
Message-ID: <m2@x>
In-Reply-To: <m1@x>
References: <m0@x> <m1@x>
From: bob@y.com
Date: Thu, 02 Jan 2025 12:00:00
Content-Type: text/html

<p>only</p><p>html</p>
From c@z Thu Jan 01 00:00:00 2025
Subject: no id

dropped
From d@z Thu Jan 01 00:00:00 2025
Message-ID: <m3@x>
From: "Eve" <eve@z.com>
Received: by host; Fri, 03 Jan 2025 00:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/plain

body
--b
Content-Type: application/pdf; name="r.pdf"
Content-Disposition: attachment; filename="r.pdf"
Content-Transfer-Encoding: base64

aGVsbG8=
--b--
"""


def test_mailbox(spark, tmp_path):
    (tmp_path / "box.mbox").write_text(MBOX)
    raw = mailbox.scan_mbox(spark, f"file://{tmp_path}/box.mbox")
    rows = mailbox.parse_messages(raw.select("raw").withColumn("source_account", F.lit("acct")).withColumn("import_id", F.lit("i1"))).cache()
    by = {r["message_id"]: r for r in rows.collect()}
    assert set(by) == {"m1@x", "m2@x", "m3@x"}
    assert by["m1@x"]["subject"] == "Café" and by["m1@x"]["recipients"]["to"] == ["bob@y.com", "carol@y.com"] and by["m1@x"]["labels"] == ["Inbox", "Work"]
    assert by["m1@x"]["date"] == datetime(2025, 1, 2, 8) and by["m2@x"]["date"] == datetime(2025, 1, 2, 12) and by["m3@x"]["date"] == datetime(2025, 1, 3)
    assert by["m2@x"]["thread_id"] == "m0@x" and by["m2@x"]["body_text"].split() == ["only", "html"]
    assert by["m3@x"]["has_attachment"] and by["m3@x"]["body_text"].strip() == "body" and by["m3@x"]["attachments"][0]["size"] == 5
    good, bad = mailbox.split_errors(rows)
    assert (good.count(), bad.count()) == (3, 0)
    fresh, accounts = mailbox.load_once(good.filter("message_id = 'm1@x'"), good.unionByName(good), "date")
    assert fresh.count() == 2 and accounts.count() == 3
    contents, bridge = mailbox.stored_attachments(good)
    assert contents.first()["storage_path"].endswith(".pdf") and bridge.count() == 1


@pytest.mark.parametrize("split", [1, 7, 50, 301, 10**6])
def test_mbox_ranges_give_every_message_once(spark, tmp_path, split):
    """The messages of scan_mbox, wherever the cuts fall: in a separator, before it, in a message that spans many ranges."""
    odd = {"a.mbox": MBOX, "b.mbox": "", "c.mbox": "no separator at all", "d.mbox": "From a\n\nFrom b\n\nFrom \nFrom c\n>From d\n\n" + "x" * 400 + "\nFrom e\n", "e.mbox": "\nFrom \nFrom \n", "f.mbox": "head\nFrom "}
    (tmp_path / "boxes").mkdir()
    for name, text in odd.items():
        (tmp_path / "boxes" / name).write_text(text)
    mbox.register(spark)
    rows = spark.read.format("mbox").option("split_bytes", split if split > 1 else 3).load(f"file://{tmp_path}/boxes")
    key = lambda r: (r["source_file"].rsplit("/", 1)[1], bytes(r["raw"]))
    want = Counter(map(key, mailbox.scan_mbox(spark, f"file://{tmp_path}/boxes").collect()))
    assert Counter(map(key, rows.collect())) == want and sum(want.values()) > 12
    if split == 1:
        for name, text in odd.items():
            for size in (1, 2):
                got = [m for a in range(0, len(text), size) for _, m in mbox.messages(io.BytesIO(text.encode()), a, min(a + size, len(text)), chunk=4)]
                assert Counter(got) == Counter({raw: n for (f, raw), n in want.items() if f == name})


def test_mbox_short_ranges_share_tasks(tmp_path):
    """Ranges of 50 bytes of three files in tasks of 1,000: few tasks, each range once, in order; and a buffer is not copied for each message."""
    for name in "abc":
        (tmp_path / name).write_text(MBOX)
    parts = mbox.MboxReader({"path": f"file://{tmp_path}", "split_bytes": "50", "task_bytes": "1000"}).partitions()
    ranges = [r for p in parts for r in p.held]
    size = 3 * len(MBOX.encode())
    assert ranges == sorted(ranges) and sum(b - a for _, a, b in ranges) == size and len(ranges) >= size // 50
    assert len(parts) <= size // 1000 + 1
    many = b"From x\nSubject: s\n\n" * 200_000
    started = time.process_time()
    assert sum(1 for _ in mbox.messages(io.BytesIO(many), 0, len(many))) == 200_000
    assert time.process_time() - started < 5


def test_quarantine_and_text_files(spark, tmp_path):
    said = MBOX.encode().split(b"\nFrom ")
    raw = spark.createDataFrame([(m, f"i{k % 2}", f"f{k}") for k, m in enumerate([*said, None])], "raw binary, import_id string, source_file string")
    path = f"file://{tmp_path}/parsed"
    assert {tuple(r) for r in mailbox.store_parsed(raw, path).collect()} == {("i0", 3, 2, 1), ("i1", 2, 0, 0)}
    assert {r["message_id"] for r in mailbox.parsed_rows(spark, path).collect()} == {"m1@x", "m2@x", "m3@x"}
    bad = {r["source_file"]: (r["error"], r["raw"]) for r in mailbox.rejected_rows(spark, path).collect()}
    assert set(bad) == {"f2", "f4"} and bad["f2"] == (mailbox.NO_ID, said[2]) and bad["f4"][1] is None and "TypeError" in bad["f4"][0]
    (tmp_path / "files/deep").mkdir(parents=True)
    for name, data in {"a.txt": "é".encode(), "b.PDF": b"%PDF", "deep/c.csv": b"a\xff,b", "d": b"x", "e.txt": b""}.items():
        (tmp_path / "files" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["bucket"], r["text"], r["size"]) for r in health.read_texts(spark, f"file://{tmp_path}/files", {"txt": "text/plain", "pdf": "application/pdf", "csv": "text/csv"}).collect()}
    assert got == {"a.txt": ("text", "é", 2), "b.PDF": ("pdf", None, 4), "c.csv": ("csv", "a\ufffd,b", 4), "d": (None, None, 1)}


def test_ledger(spark):
    ledger = spark.createDataFrame([("1", "a", "f1", datetime(2025, 1, 1), "running"), ("2", "a", "f1", datetime(2025, 1, 2), "running"), ("3", "a", "f2", datetime(2025, 1, 1), "completed")], "id string, source_account string, source_file string, started_at timestamp, status string")
    wanted = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("a", "f3")], "source_account string, source_file string")
    resume, start = mailbox.open_imports(ledger, wanted)
    assert [r["import_id"] for r in resume.collect()] == ["2"] and [r["source_file"] for r in start.collect()] == ["f3"]


def test_event_extraction_and_upsert(spark):
    content = '[{"title": " Trip ", "event_type": "travel", "date": "2025-03-09", "claims": [{"text": "c", "source_markers": ["S1", "S2"]}, {"text": "uncited", "source_markers": ["S9"]}]}, {"title": "x", "event_type": "nope", "date": "2025-03-01", "claims": []}]'
    outputs = spark.createDataFrame([("o1", content, date(2025, 3, 1), date(2025, 3, 5)), ("o2", "not json", date(2025, 3, 1), date(2025, 3, 5))], "output_id string, content string, window_start date, window_end date")
    sources = spark.createDataFrame([("o1", "S1", "msg_1"), ("o1", "S2", "msg_2")], "output_id string, marker string, source_id string")
    rows = events.parse_extracted(outputs, sources).collect()
    assert len(rows) == 1 and rows[0]["title"] == "Trip" and rows[0]["date"] == date(2025, 3, 5) and rows[0]["evidence_strength"] == "high" and len(rows[0]["claims"]) == 1
    stored = spark.createDataFrame([("e1", "Trip", datetime(2025, 3, 4), None, "automatic", "unreviewed", "s", 1), ("e2", "Move", datetime(2025, 3, 4), None, "automatic", "confirmed", "s", 1)], "id string, title string, time_start timestamp, time_end timestamp, origin string, status string, scope_fingerprint string, current_version int")
    versions = spark.createDataFrame([("e1", 1), ("e2", 1)], "event_id string, version int")
    new = spark.createDataFrame([(f"n{i}", "s", t, date(2025, 3, 4), date(2025, 3, 1), date(2025, 3, 6), "travel", "low", None) for i, t in enumerate(["trip", "MOVE", "other"])], "new_id string, scope_fingerprint string, title string, date date, burst_start date, burst_end date, event_type string, evidence_strength string, summary string")
    after, more, outcome = events.upsert(stored, versions, new)
    assert {r["new_id"]: (r["event_id"], r["version"], r["outcome"]) for r in outcome.collect()} == {"n0": ("e1", 2, "superseded"), "n1": ("e2", 2, "suggested"), "n2": ("n2", 1, "created")}
    assert {r["id"]: r["current_version"] for r in after.collect()} == {"e1": 2, "e2": 1, "n2": 1} and more.count() == 5


def test_conflicts_and_manifest(spark):
    claims = spark.createDataFrame([("e", 0, "direct", [("s1",)]), ("e", 1, "conflicting", [("s1",)]), ("e", 2, "direct", [("s2",)])], "event_id string, position int, status string, citations array<struct<source_id:string>>")
    assert {r["position"] for r in events.claim_conflicts(claims).collect()} == {0, 1}
    use = "source_id string, position int, excerpt_hash string"
    m = events.manifest(spark.createDataFrame([("a", 1, None)], use), spark.createDataFrame([("a", 0, "h"), ("b", 1, None)], use), spark.createDataFrame([("a", "T")], "source_id string, title string"))
    assert {r["source_id"]: (r["title"], r["excerpt_hash"]) for r in m.collect()} == {"a": ("T", "h"), "b": (None, None)}
    one = events.fingerprint(m.select("source_id", "title"), "source_id", "title").first()[0]
    assert one == events.fingerprint(m.select("source_id", "title").orderBy(F.desc("source_id")), "source_id", "title").first()[0]


def test_topic_terms(spark):
    subjects = ["The Meeting about Renovation and Plumbing", "RE: Renovation quote for plumbing", "fw: meeting notes", "a to of"]
    r = topics.top_terms(spark.createDataFrame([(1, s) for s in subjects], "topic int, subject string")).first()
    assert {"renovation", "plumbing"} <= set(r["terms"]) and all(len(t) >= 3 for t in r["terms"]) and not {"the", "and"} & set(r["terms"])


def test_health_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("application/pdf", "x", 9), ("image/png", "", 9), ("nope", None, 9), ("text/plain", " \u0000", 9)], "ct string, t string, size int")
    rows = df.select(health.outcome(F.lit(None).cast("string"), health.route("ct"), F.col("t"), F.col("size")).alias("o")).collect()
    assert [r["o"] for r in rows] == ["extracted", "skipped", "skipped", "skipped"]
    calls = []
    make = lambda: calls.append(1) or df
    assert versions.materialised(spark, f"file://{tmp_path}/m", "k", "1-2025-01-01 00:00:00", make).count() == 4
    assert versions.materialised(spark, f"file://{tmp_path}/m", "k", "1-2025-01-01 00:00:00", make).count() == 4 and len(calls) == 1
    sinks.write_csv(df, f"{tmp_path}/c")
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 4 and spark.read.json(f"{tmp_path}/j").count() == 4
    assert set(schemas.SCHEMAS) >= {"emails", "contacts", "app_events"}


def feed(spark, rows, path, parts=3):
    rows.repartition(parts).write.parquet(path)
    return jobs.read_files(spark, path, rows.schema, per_trigger=1)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = feed(spark, rows, f"{tmp_path}/in")
    out: dict = {}
    job = jobs.each_batch(jobs.bucket_counts(stream, key="event_type", delay="100 days"), lambda b, i: out.update({(r["window"]["start"], r["event_type"]): r["n"] for r in b.collect()}), f"{tmp_path}/cp", "update")
    job.awaitTermination(120)
    assert out == {(r["window"]["start"], r["event_type"]): r["n"] for r in jobs.bucket_counts(rows, key="event_type").collect()}


def test_stream_store_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 7}", i) for i in range(20)], "message_id string, v int")
    stream = feed(spark, rows, f"{tmp_path}/in")
    jobs.each_batch(stream, jobs.store_new(f"file://{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination(120)
    jobs.each_batch(jobs.read_files(spark, f"{tmp_path}/in", rows.schema), jobs.store_new(f"file://{tmp_path}/out"), f"{tmp_path}/cp2").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_stream_address_book_equals_batch(spark, sf_dir, tmp_path):
    """The book of the stream's last state, over several batches, against the full build."""
    from lettermill.operators import contacts
    from lettermill.sources import archive

    mails = archive.emails(spark, sf_dir).select("id", "sender_address", "sender_name", "recipients", "date")
    me = archive.identities(spark, sf_dir)
    odd = [(-1, " U1@d1.example ", "", (["x@y.z", "X@y.z", ""], None, None), None), (-2, None, "nobody", (["x@y.z"], [], []), None), (-3, "only@x.y", None, None, None)]
    mails = mails.unionByName(spark.createDataFrame(odd, "id long, sender_address string, sender_name string, recipients struct<to:array<string>, cc:array<string>, bcc:array<string>>, date timestamp"))
    me = me.unionByName(spark.createDataFrame([("u1@d1.example",)], "address string"))
    stream = feed(spark, mails, f"{tmp_path}/in", 4)
    state: dict = {}
    job = jobs.each_batch(jobs.address_statistics(stream, me), lambda b, i: state.update({(r["address"], r["name"]): r for r in b.collect()}), f"{tmp_path}/cp", "update")
    job.awaitTermination(300)
    last = spark.createDataFrame(list(state.values()), "address string, name string, messages_from long, messages_to long, first_seen timestamp, last_seen timestamp")
    columns = ("address", "name", "name_variants", "is_user", "first_seen", "last_seen", "messages_from", "messages_to")
    rows = lambda t: sorted((tuple(r) for r in t.select(*columns).collect()), key=str)
    assert len(job.recentProgress) > 2 and rows(jobs.book_of_statistics(last, me)) == rows(contacts.address_book(mails, me))


def test_stream_counts_late_rows(spark, tmp_path):
    """Rows of windows that the watermark has closed are left out and counted."""
    src = f"{tmp_path}/in"
    parts = [["2025-01-01 10:00", "2025-01-05 10:00"], ["2025-01-05 10:20"], ["2025-01-01 10:30", "2025-01-01 11:30", "2025-01-05 10:40"]]
    n = 0
    for part in parts:
        spark.createDataFrame([(datetime.fromisoformat(t),) for t in part], "ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, spark.createDataFrame([], "ts timestamp").schema)
        job = jobs.each_batch(jobs.bucket_counts(stream), lambda b, i: b.count(), f"{tmp_path}/cp", "update")
        job.awaitTermination(120)
        n += jobs.least_late_rows(job)
    assert n == 2


def test_stream_alarms(spark, tmp_path):
    schema = "thread_id string, message_id string, date timestamp, mine boolean"
    first = [("t1", "a", datetime(2025, 1, 1), False), ("t2", "b", datetime(2025, 1, 1), False)]
    later = [("t2", "c", datetime(2025, 1, 2), True), ("t9", "z", datetime(2025, 1, 10), True)]
    last = [("t9", "y", datetime(2025, 1, 11), True)]
    src, out = f"{tmp_path}/in", []
    for i, part in enumerate((first, later, last)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, spark.createDataFrame([], schema).schema)
        jobs.each_batch(jobs.unanswered_alarms(stream, days=3), lambda b, n: out.extend(r["message_id"] for r in b.collect()), f"{tmp_path}/cp").awaitTermination(120)
    assert out == ["a"]
