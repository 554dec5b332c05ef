"""Attachments as files: lists, version families, differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.operators.components import merged_nodes, shared_key_edges
from lettermill.operators.predicates import content_family, holds
from lettermill.staging import staged

HUNKS = 200
#: Amounts in a line (fixed value).
AMOUNT = r"[$€£]?\s?\d[\d,.]*"
#: Trailing version marks of a file name (fixed value).
VERSION = r"(?i)(?:[-_ ]?(?:v?\d+|final|draft|copy|\(\d+\)))+$"


def filename_stem(name: str | Column) -> Column:
    """The name in lower case without a short extension and without trailing version marks; null counts as empty."""
    low = F.lower(F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))))
    bare = F.regexp_replace(low, r"(?<=.)\.[\p{L}\p{N}+-]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, VERSION, ""), VERSION, "")


def amounts(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))


def listing(lines: DataFrame, mails: DataFrame, *, one_a_hash: bool = False, occurrences: int = 20) -> DataFrame:
    """Attachments with their message's date and ``duplicates``; ``one_a_hash`` keeps the newest of each content with its newest occurrences."""
    rows = lines.join(mails.select(F.col("id").alias("email_id"), "date", "sender_address", "thread_id"), "email_id")
    counts = lines.groupBy("sha256").agg(F.count(F.lit(1)).alias("duplicates"))
    if not one_a_hash:
        return rows.join(counts, "sha256")
    newest = Window.partitionBy("sha256").orderBy(F.col("date").desc_nulls_last(), F.desc("email_id"))
    near = rows.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= occurrences)
    held = near.groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "email_id"))), lambda x: x["email_id"]).alias("occurrences"))
    return near.filter("r = 1").drop("r").join(counts, "sha256").join(held, "sha256")


def page(bridge: DataFrame, attachments: DataFrame, contents: DataFrame, mails: DataFrame, *, scope: Column | None = None, filename: str | None = None, family: str | None = None, status: str | None = None, after: tuple[Any, int, str] | None = None, limit: int = 50) -> DataFrame:
    """The newest files in scope: key, email_id, sha256, filename, content_type, date, status, duplicates, family_count.

    ``scope`` filters by the message, ``filename`` by a part of the name, ``family`` by ``content_family``, ``status`` by the extraction
    (pending where there is none). ``after`` is the (date, email_id, sha256) of the page before; undated files come last. A page has
    ``limit`` rows, so its counts, over all files whatever the scope, come from joins with so many keys: messages that carry the same
    content, and the files of the same family, the file itself included.
    """
    held = bridge.join(mails.withColumnRenamed("id", "email_id"), "email_id").withColumn("key", F.concat_ws(":", "email_id", "sha256"))
    rows = held if scope is None else held.filter(scope)
    rows = rows.join(attachments.select("sha256", "content_type"), "sha256", "left").join(contents.select("sha256", "status"), "sha256", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    if filename is not None:
        rows = rows.filter(holds(F.col("filename"), filename))
    if family is not None:
        rows = rows.filter(content_family(F.col("content_type")) == family)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if after is not None:
        date, email_id, sha256 = after
        at = F.lit(date).cast("timestamp")
        behind = (F.col("email_id") < email_id) | ((F.col("email_id") == email_id) & (F.col("sha256") > sha256))
        rows = rows.filter(F.col("date").isNull() & behind if date is None else (F.col("date") < at) | ((F.col("date") == at) & behind) | F.col("date").isNull())
    order = (F.col("date").desc_nulls_last(), F.desc("email_id"), F.col("sha256"))
    kept = ("key", "email_id", "sha256", "filename", "content_type", "date", "status")
    found = staged(rows.select(*kept).orderBy(*order).limit(limit), "page")
    copies = bridge.join(F.broadcast(found.select("sha256").distinct()), "sha256").groupBy("sha256").agg(F.countDistinct("email_id").alias("duplicates"))  # limit rows
    kin = families(held.select("key", "sha256", "filename", "sender_address", "thread_id"), found).groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("family_count"))
    return found.join(copies, "sha256").join(kin, "key").select(*kept, "duplicates", "family_count").orderBy(*order)


def newest_parent(lines: DataFrame, mails: DataFrame) -> DataFrame:
    """One row a content with the file name of its attachment and the newest message that carries it."""
    rows = lines.join(mails.select(F.col("id").alias("email_id"), "date", "sender_address", "thread_id"), "email_id")
    newest = Window.partitionBy("sha256").orderBy(F.col("date").desc_nulls_last(), F.desc("email_id"))
    return rows.withColumn("r", F.row_number().over(newest)).filter("r = 1").select("sha256", "filename", "email_id", "date", "sender_address", "thread_id")


def families(files: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """a, b, confidence, signals: for every file its family, files of the same stem and the same sender or thread (itself included).

    ``asked`` (key) limits the files whose families are listed. Without it every file is asked for, and the rows are the squares of
    the families' sizes, as their definition says.

    ``files`` is (key, sha256, filename, sender_address, thread_id). Two equi-joins on stem and sender or thread stand for the
    disjunction, so no nested loop is needed. An empty stem has no family but itself.
    """
    rows = files.select("key", "sha256", "sender_address", "thread_id", filename_stem("filename").alias("stem"))
    stems = rows.filter("stem <> ''")
    side = lambda x: stems.select(*(F.col(c).alias(f"{c}_{x}") for c in rows.columns))
    a, b = side("a"), side("b")
    if asked is not None:
        wanted = asked.select("key").distinct()
        a, rows = a.join(wanted.withColumnRenamed("key", "key_a"), "key_a", "left_semi"), rows.join(wanted, "key", "left_semi")
    by = lambda c: a.join(b, (F.col("stem_a") == F.col("stem_b")) & (F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col("key_a") != F.col("key_b")))
    pairs = by("sender_address").union(by("thread_id")).distinct()
    exact = F.col("sha256_a") == F.col("sha256_b")
    signals = F.array_compact(F.array(F.lit("stem"), F.when(F.col("sender_address_a") == F.col("sender_address_b"), "sender"), F.when(F.col("thread_id_a") == F.col("thread_id_b"), "thread"), F.when(exact, "sha256")))
    found = pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.when(exact, "exact-duplicate").otherwise("probable-version").alias("confidence"), signals.alias("signals"))
    own = rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit("exact-duplicate").alias("confidence"), F.array_compact(F.array(F.when(F.col("stem") != "", "stem"), F.when(F.col("sender_address").isNotNull(), "sender"), F.when(F.col("thread_id").isNotNull(), "thread"), F.lit("sha256"))).alias("signals"))
    return found.unionByName(own)


def family_members(files: DataFrame) -> DataFrame:
    """key, family: every file with the smallest key of its family. A family is what hangs together by the same stem and the same
    sender or thread, so the rows grow with the files, not with the pairs. An empty stem has no family but itself."""
    rows = files.filter("key is not null").select("key", "sender_address", "thread_id", filename_stem("filename").alias("stem"))
    rows = staged(rows.withColumn("n", F.monotonically_increasing_id()), "files")
    by = lambda kind, c: rows.filter((F.col("stem") != "") & F.col(c).isNotNull()).select("n", F.lit(kind).alias("kind"), "stem", F.col(c).alias("v"))
    ties = by("s", "sender_address").unionByName(by("t", "thread_id"))
    edges = shared_key_edges(ties, "kind", "stem", "v").unionAll(shared_key_edges(rows.select("n", "key"), "key"))
    placed = rows.select("n", "key").join(merged_nodes(staged(edges, "edges")), "n", "left").select("key", F.coalesce("label", "n").alias("label"))
    placed = staged(placed, "placed")
    return placed.join(placed.groupBy("label").agg(F.min("key").alias("family")), "label").select("key", "family").distinct()


def versions(texts: DataFrame, group: str, block_ids: int = 1 << 16) -> DataFrame:
    """key, new, old: each text of (key, text, ``group``) beside the one of the next smaller key of its group; the first has none.

    Keys are distinct integers; rows without a key are left out. Keys alone are put in order, in blocks, so that a group of any
    size is dealt to many tasks; texts then join by key.
    """
    ids = texts.filter("key is not null").select(F.col(group).alias("g"), "key", F.floor(F.col("key") / block_ids).alias("block"))
    ends = ids.groupBy("g", "block").agg(F.max("key").alias("last"))
    ends = ends.select(F.col("g").alias("eg"), F.col("block").alias("eb"), F.lag("last").over(Window.partitionBy("g").orderBy("block")).alias("before"))
    ids = ids.withColumn("lag", F.lag("key").over(Window.partitionBy("g", "block").orderBy("key")))
    ids = ids.join(ends, F.col("g").eqNullSafe(F.col("eg")) & (F.col("block") == F.col("eb"))).select("key", F.coalesce("lag", "before").alias("old_key")).filter("old_key is not null")
    old = texts.select(F.col("key").alias("old_key"), F.col("text").alias("old"))
    return ids.join(texts.select("key", F.col("text").alias("new")), "key").join(old, "old_key").select("key", "new", "old")


def changed_lines(pairs: DataFrame) -> DataFrame:
    """key, added, removed: distinct lines that only one of two texts (old, new) has; built-in functions only."""
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1)
    return pairs.select("key", F.array_except(lines("new"), lines("old")).alias("added"), F.array_except(lines("old"), lines("new")).alias("removed"))


#: Pairs of texts whose differences a task holds.
PAIRS = 32
DIFF = "array<struct<a_start:int,b_start:int,lines:array<struct<kind:string,text:string>>>>"
_DIFF = pa.list_(pa.struct([("a_start", pa.int32()), ("b_start", pa.int32()), ("lines", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))]))


def _hunks(old: str, new: str, context: int) -> tuple[list[dict], bool]:
    x, y = old.splitlines(), new.splitlines()
    groups = list(difflib.SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context))
    hunks = [
        {"a_start": g[0][1], "b_start": g[0][3], "lines": [{"kind": k, "text": t} for tag, i, j, m, n in g for k, t in ([("same", t) for t in x[i:j]] if tag == "equal" else [("del", t) for t in x[i:j]] + [("add", t) for t in y[m:n]])]}
        for g in groups[:HUNKS]
    ]
    return hunks, len(groups) > HUNKS


def line_diff(pairs: DataFrame, context: int = 2) -> DataFrame:
    """key, hunks, truncated: the line difference of two texts (old, new), 200 hunks at most. A task holds ``PAIRS`` of them at a time."""
    key = pairs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), PAIRS):
                part = batch.slice(i, PAIRS)
                made = [_hunks(a.as_py() or "", b.as_py() or "", context) for a, b in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h for h, _ in made], _DIFF), pa.array([t for _, t in made], pa.bool_())], names=["key", "hunks", "truncated"])

    return pairs.select("key", "old", "new").mapInArrow(run, f"key {key}, hunks {DIFF}, truncated boolean")


def amount_changes(diffs: DataFrame) -> DataFrame:
    """key, kind, text, amounts of the added and removed lines that name an amount."""
    lines = diffs.select("key", F.explode("hunks").alias("h")).select("key", F.explode("h.lines").alias("l")).select("key", "l.kind", "l.text").filter("kind <> 'same'")
    return lines.withColumn("amounts", amounts("text")).filter(F.size("amounts") > 0)
