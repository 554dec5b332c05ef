"""Fixed message queries: lists, unanswered messages, correspondents, accounts, threads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.operators.predicates import in_range, message_filter, order_by, received_by


def find(mails: DataFrame, *, order: str = "date DESC", limit: int | None = 50, offset: int = 0, **filters: Any) -> DataFrame:
    """A page of the messages that pass the filters; ``limit=None`` gives all of them, unsorted."""
    rows = mails.filter(message_filter(**filters))
    return rows if limit is None else rows.orderBy(*order_by(order)).offset(offset).limit(limit)


def by_ids(mails: DataFrame, ids: list[Any]) -> DataFrame:
    """Records in the order of ``ids``; unknown ids are skipped. ``ids`` is an argument list, so it is a local relation."""
    kind = mails.schema["id"].dataType
    asked = mails.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "wanted string, pos int").select(F.col("wanted").cast(kind).alias("id"), "pos")
    return asked.join(mails, "id").orderBy("pos")


def thread(mails: DataFrame, thread_id: str) -> DataFrame:
    """The messages of a thread, oldest first; null dates last, ties by id."""
    return mails.filter(F.col("thread_id") == thread_id).orderBy(F.col("date").asc_nulls_last(), "id")


def thread_of(mails: DataFrame, message_id: str) -> DataFrame:
    """The whole thread of a message, oldest first; no rows for an unknown message."""
    wanted = mails.filter(F.col("message_id") == message_id).select("thread_id").distinct()
    return mails.join(wanted, "thread_id", "left_semi").orderBy(F.col("date").asc_nulls_last(), "id")


def identities(imports: DataFrame, configured: list[str], account: str | None = None) -> DataFrame:
    """address, pos: the owner's addresses: the configured ones in their order, then the accounts of ``imports`` (source_account).

    ``account`` alone counts where it is given. Empty and repeated addresses count once or not at all; no address at all is an error.
    """
    given = [account] if account is not None else list(dict.fromkeys(a for a in configured if a))
    own = imports.sparkSession.createDataFrame([(a, i) for i, a in enumerate(given)], "address string, pos int")
    if account is not None:
        return own
    more = imports.select(F.col("source_account").alias("address")).filter("address <> ''").distinct().join(own, "address", "left_anti")
    listed = own.unionByName(more.select("address", (F.row_number().over(Window.orderBy("address")) + (len(given) - 1)).alias("pos")))
    if not given and more.isEmpty():
        raise ValueError("no address is configured and no account is imported")
    return listed


def participants(mails: DataFrame, *keep: str) -> DataFrame:
    """One row for each (message, arm, recipient): ``keep`` columns, address, domain, arm."""
    arm = lambda a: F.transform(F.coalesce(F.col(f"recipients.{a}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(a).alias("recipient_type"), x.alias("recipient_address")))
    rows = mails.select(*keep, F.explode(F.concat(arm("to"), arm("cc"), arm("bcc"))).alias("r"))
    return rows.select(*keep, "r.recipient_type", "r.recipient_address", F.split_part(F.col("r.recipient_address"), F.lit("@"), F.lit(2)).alias("recipient_domain"))


def labels(mails: DataFrame, *keep: str) -> DataFrame:
    return mails.select(*keep, F.explode("labels").alias("label"))


def _mine(mails: DataFrame, me: DataFrame) -> DataFrame:
    """``mine``: whether the sender is one of the owner's addresses."""
    own = me.select(F.col("address").alias("sender_address"), F.lit(True).alias("m")).distinct()
    return mails.join(own, "sender_address", "left").withColumn("mine", F.col("m").isNotNull()).drop("m")


def unreplied(mails: DataFrame, me: DataFrame, *, direction: str = "inbound", recipient: str | None = None, human: DataFrame | None = None, **filters: Any) -> DataFrame:
    """Dated messages without a later answer in their thread.

    inbound: from others, and no later message by me; outbound: by me, and no later message by anyone else; outbound with
    ``recipient``: sent to that address, and no later message by it. ``human`` keeps inbound senders in that (address)
    table. The latest answer of each thread is one aggregate, joined once on the thread: no range join. Filters narrow the
    messages that wait, never the answers.
    """
    if direction not in ("inbound", "outbound"):
        raise ValueError("direction must be inbound or outbound")
    if recipient is not None and direction == "inbound":
        raise ValueError("recipient needs direction='outbound'")
    tagged = _mine(mails.filter("date is not null"), me)
    if direction == "inbound":
        waits, answers = tagged.filter("not mine and sender_address is not null"), tagged.filter("mine")
        if human is not None:
            waits = waits.join(human.select(F.col("address").alias("sender_address")), "sender_address", "left_semi")
    else:
        waits = tagged.filter("mine")
        answers = tagged.filter("not mine")
        if recipient is not None:
            waits, answers = waits.filter(received_by(recipient)), tagged.filter(F.col("sender_address") == recipient)
    last = answers.groupBy("thread_id").agg(F.max("date").alias("answered"))
    open_ = waits.filter(message_filter(**filters)).join(last, "thread_id", "left").filter("answered is null or answered <= date")
    return open_.drop("answered", "mine")


def top_contacts(mails: DataFrame, me: DataFrame, *, direction: str = "both", group_by: str = "address", after: Any = None, before: Any = None, exclude_domains: list[str] | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """key, messages: inbound counts messages by their sender, outbound every (message, arm) by its recipient; both adds them up.

    ``group_by`` is address, domain or contact; the last needs ``contacts`` (address, contact_id), and unlinked addresses stay
    separate. Senders and recipients without an address drop out. The messages are read once, whatever the direction.
    """
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError("direction must be inbound, outbound or both")
    rows = mails.filter(in_range(F.col("date"), after, before))
    own = me.select(F.col("address")).distinct()
    none = F.array().cast("array<string>")
    met = F.array("sender_address") if direction != "outbound" else none
    if direction != "inbound":
        rows = _mine(rows, own)
        arms = F.concat(*(F.coalesce(F.col(f"recipients.{a}"), none) for a in ("to", "cc", "bcc")))
        met = F.concat(met, F.when(F.col("mine"), arms).otherwise(none))
    both = rows.select(F.explode(met).alias("address")).filter("address is not null")
    counts = both.groupBy("address").agg(F.count(F.lit(1)).alias("messages")).join(own, "address", "left_anti")
    domain = F.split_part("address", F.lit("@"), F.lit(2))
    if exclude_domains:
        counts = counts.filter(~domain.isin(exclude_domains))
    if group_by == "contact":
        linked = counts.join(contacts.select("address", "contact_id"), "address", "left")
        return linked.groupBy(F.coalesce("contact_id", "address").alias("key")).agg(F.sum("messages").alias("messages"))
    key = {"address": F.col("address"), "domain": domain}[group_by]
    return counts.groupBy(key.alias("key")).agg(F.sum("messages").alias("messages"))


def account_summary(mails: DataFrame, accounts: DataFrame) -> DataFrame:
    rows = accounts.join(mails.select(F.col("id").alias("email_id"), "date"), "email_id")
    return rows.groupBy("source_account").agg(F.countDistinct("email_id").alias("messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("import_id").alias("imports"))


def long_threads(mails: DataFrame, *, min_messages: int = 5, participant: str | None = None, after: Any = None) -> DataFrame:
    """Threads of at least so many messages; with ``participant``, only those where that address sent one."""
    rows = mails.filter(in_range(F.col("date"), after))
    grouped = rows.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_sort(F.collect_set("sender_address")).alias("participants"))
    grouped = grouped.filter(F.col("messages") >= min_messages)
    return grouped if participant is None else grouped.filter(F.array_contains("participants", participant))


def correspondence(mails: DataFrame, addresses: DataFrame) -> DataFrame:
    """Messages sent by or to any of the addresses (address)."""
    wanted = addresses.select("address").distinct()
    sent = mails.select("id", F.col("sender_address").alias("address"))
    got = participants(mails, "id").select("id", F.col("recipient_address").alias("address"))
    ids = sent.unionByName(got).join(wanted, "address", "left_semi").select("id").distinct()
    return mails.join(ids, "id", "left_semi")


def facets(mails: DataFrame, top: int = 10) -> DataFrame:
    """facet, value, n: the largest mailboxes, messages a year, with and without attachment; one pass over the rows."""
    year = F.year("date").cast("string")
    keys = F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in (("mailbox", F.col("source_account")), ("year", year), ("attachment", F.col("has_attachment").cast("string")))))
    counts = mails.select(F.explode(keys).alias("k")).select("k.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    boxes = counts.filter("facet = 'mailbox'").orderBy(F.desc("n"), "value").limit(top)
    return boxes.unionByName(counts.filter("facet <> 'mailbox'"))


def snippet(text: Column, term: str, size: int = 300, lead: int = 50) -> Column:
    """At most ``size`` characters around the first hit, with marks where text is cut off."""
    at = F.instr(F.lower(text), F.lit(term.lower()))
    start = F.greatest(F.lit(1), at - lead)
    cut = F.substring(text, start, F.lit(size))
    return F.when(at == 0, F.concat(F.substring(text, F.lit(1), F.lit(size)), F.when(F.length(text) > size, "…").otherwise(""))).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(F.length(text) >= start + size, "…").otherwise("")))


def matched_field(term: str) -> Column:
    low = F.lit(term.lower())
    return F.when(F.lower("subject").contains(low), "subject").when(F.lower("body_text").contains(low), "body").otherwise("metadata")


def projected(mails: DataFrame, fields: list[str], body_max_chars: int | None = None) -> DataFrame:
    """Chosen columns; ``body_length`` is computed, and a cut body carries ``body_truncated``. Unknown names are errors."""
    known = {*mails.columns, "body_length"}
    if unknown := [f for f in fields if f not in known]:
        raise ValueError(f"unknown fields: {unknown}")
    body = F.col("body_text") if "body_text" in mails.columns else F.lit(None).cast("string")
    out: list[Column] = []
    for f in fields:
        if f == "body_length":
            out.append(F.length(body).alias(f))
        elif f == "body_text" and body_max_chars is not None:
            long = F.length(body) > body_max_chars
            out += [F.when(long, F.concat(F.substring(body, 1, body_max_chars), F.lit("..."))).otherwise(body).alias(f), F.coalesce(long, F.lit(False)).alias("body_truncated")]
        else:
            out.append(F.col(f))
    return mails.select(*out)
