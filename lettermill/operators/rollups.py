"""Partial aggregates of each import, merged when they are read: lanes, correspondents, address book and summary without the messages.

An import adds five small tables: days (messages, attachments and a sketch of the senders), correspondents a day, address figures,
thread sizes and attachment contents. Sums, minima, maxima and sketches merge, so what is read equals a full build. A version, as of
``health.data_version``, goes with each import and with the owner's addresses; an import whose version has changed is added again and
takes the place of its old figures in one step.
"""

from __future__ import annotations

import hashlib
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.contacts import address_statistics, book_of_statistics
from lettermill.operators.predicates import in_range
from lettermill.operators.timeline import bucket
from lettermill.sources import versions

KINDS = ("days", "met", "book", "threads", "contents")
#: The sketch has 2 ** LG registers; its standard error is 1.04 / sqrt(2 ** LG), 1.6 percent.
LG = 12


def day_partials(mails: DataFrame, bridge: DataFrame) -> DataFrame:
    """day (null for undated), messages, attachments, people (a sketch of the distinct senders)."""
    dated = mails.select(F.col("id").alias("email_id"), F.to_date("date").alias("day"), "sender_address")
    sent = dated.groupBy("day").agg(F.count(F.lit(1)).alias("messages"), F.hll_sketch_agg("sender_address", LG).alias("people"))
    held = bridge.join(dated.select("email_id", "day"), "email_id").groupBy("day").agg(F.count(F.lit(1)).alias("attachments"))
    both = sent.join(held.withColumnRenamed("day", "d"), F.col("day").eqNullSafe(F.col("d")), "left")
    return both.select("day", "messages", F.coalesce("attachments", F.lit(0)).alias("attachments"), "people")


def met_partials(mails: DataFrame, me: DataFrame) -> DataFrame:
    """day, direction, address, n: a message inbound by its sender, and by each recipient in each arm outbound where the owner sent it."""
    own = me.select(F.col("address").alias("sender_address"), F.lit(True).alias("m")).distinct()
    none = F.array().cast("array<string>")
    arms = F.concat(*(F.coalesce(F.col(f"recipients.{a}"), none) for a in ("to", "cc", "bcc")))
    side = lambda way, addresses: F.transform(addresses, lambda a: F.struct(F.lit(way).alias("direction"), a.alias("address")))
    met = F.concat(side("inbound", F.array("sender_address")), side("outbound", F.when(F.col("m"), arms).otherwise(none)))
    rows = mails.join(own, "sender_address", "left").select(F.to_date("date").alias("day"), F.explode(met).alias("x")).select("day", "x.*")
    return rows.filter("address is not null").groupBy("day", "direction", "address").agg(F.count(F.lit(1)).alias("n"))


def owner_mark(me: DataFrame) -> str:
    """A short mark of the owner's addresses, which outbound figures depend on; a bounded table."""
    return hashlib.sha256("\n".join(sorted({r["address"] or "" for r in me.select("address").distinct().collect()})).encode()).hexdigest()[:16]


def add_import(root: str, import_id: str, version: str, mails: DataFrame, bridge: DataFrame, me: DataFrame) -> bool:
    """Stores the partial aggregates of one import's messages; False if this version is there already.

    ``bridge`` has email_id and sha256 of the attachments. The version should hold ``owner_mark`` as well.
    """
    if versions.lookup(root, import_id, version):
        return False
    place = versions.new_place(root)
    files = bridge.join(mails.select(F.col("id").alias("email_id")), "email_id", "left_semi")
    made = {
        "days": day_partials(mails, files), "met": met_partials(mails, me), "book": address_statistics(mails, me),
        "threads": mails.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n")), "contents": files.select("sha256").distinct(),
    }
    for kind, rows in made.items():
        rows.write.parquet(f"{place}/{kind}")
    versions.publish(root, import_id, version, place)
    versions.supersede(root, import_id)
    return True


def stale(root: str, current: dict[str, str]) -> list[str]:
    """Which of the imports (with their current versions) are not stored, or are stored as of another version."""
    held = versions.newest(root)
    return sorted(i for i, v in current.items() if i not in held or held[i].version != v)


def partials(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The rows of a kind of all imports, each in its newest version. ``ValueError`` if there is none."""
    places = [e.place for e in versions.newest(root).values()]
    if not places:
        raise ValueError("no import is stored")
    return spark.read.parquet(*(f"{p}/{kind}" for p in places))


def _whole_day(moment: Any) -> None:
    at = moment if isinstance(moment, datetime) or moment is None else datetime.fromisoformat(str(moment))
    if at is not None and (at.hour, at.minute, at.second, at.microsecond) != (0, 0, 0, 0):
        raise ValueError("a range of days begins and ends at midnight")


def lanes(days: DataFrame, *, unit: str, after: Any = None, before: Any = None) -> DataFrame:
    """lane, bucket, n as ``timeline.lanes`` has them, from days: messages, attachments and people of the viewport, density of all.

    People are estimated from sketches, with a standard error of 1.6 percent; the others are exact. Units are days and longer.
    """
    if unit == "hour":
        raise ValueError("days do not hold hours")
    _whole_day(after)
    _whole_day(before)
    at = F.col("day").cast("timestamp")
    rows = days.filter("day is not null").withColumn("bucket", bucket(unit, at))
    seen = rows.filter(in_range(at, after, before)).groupBy("bucket").agg(F.sum("messages").alias("messages"), F.sum("attachments").alias("attachments"), F.hll_sketch_estimate(F.hll_union_agg("people")).alias("people"))
    lane = lambda name: F.struct(F.lit(name).alias("lane"), F.col(name).alias("n"))
    view = seen.select("bucket", F.explode(F.array(*map(lane, ("messages", "attachments", "people")))).alias("x")).select("x.lane", "bucket", "x.n").filter("n > 0 or lane <> 'attachments'")
    return view.unionByName(rows.groupBy("bucket").agg(F.sum("messages").alias("n")).select(F.lit("density").alias("lane"), "bucket", "n"))


def top_contacts(met: DataFrame, me: DataFrame, *, direction: str = "both", after: Any = None, before: Any = None) -> DataFrame:
    """key, messages as ``messages.top_contacts`` has them by address, from the correspondents a day."""
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError("direction must be inbound, outbound or both")
    _whole_day(after)
    _whole_day(before)
    rows = met.filter(in_range(F.col("day").cast("timestamp"), after, before))
    rows = rows if direction == "both" else rows.filter(F.col("direction") == direction)
    counts = rows.groupBy(F.col("address").alias("key")).agg(F.sum("n").alias("messages"))
    return counts.join(me.select(F.col("address").alias("key")).distinct(), "key", "left_anti")


def address_book(book: DataFrame, me: DataFrame) -> DataFrame:
    """The address book from the address figures of all imports."""
    merged = book.groupBy("address", "name").agg(F.sum("messages_from").alias("messages_from"), F.sum("messages_to").alias("messages_to"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return book_of_statistics(merged, me)


def summary(spark: SparkSession, root: str, contacts: DataFrame) -> DataFrame:
    """The row of ``health.archive_summary``: messages, threads, undated, attachments, contacts."""
    totals = partials(spark, root, "days").agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("messages"))), F.lit(0)).alias("undated"))
    threads = partials(spark, root, "threads").filter("thread_id is not null").agg(F.countDistinct("thread_id").alias("threads"))
    files = partials(spark, root, "contents").agg(F.countDistinct("sha256").alias("attachments"))
    one = totals.crossJoin(threads).crossJoin(files).crossJoin(contacts.agg(F.count(F.lit(1)).alias("contacts")))  # of one row each
    return one.select("messages", "threads", "undated", "attachments", "contacts")
