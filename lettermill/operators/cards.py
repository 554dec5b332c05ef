"""Single-source views in batch form: thread cards, envelopes, attachment texts, activity, grouped results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.operators.messages import participants


def thread_cards(mails: DataFrame) -> DataFrame:
    """thread_id, messages, first_date, last_date, subject (the first that is not null), participants (senders and recipients)."""
    people = mails.select("thread_id", F.col("sender_address").alias("a")).unionByName(participants(mails, "thread_id").select("thread_id", F.col("recipient_address").alias("a")))
    who = people.filter("a is not null").groupBy("thread_id").agg(F.countDistinct("a").alias("participants"))
    first = F.min_by("subject", F.when(F.col("subject").isNotNull(), F.struct(F.col("date").isNull(), "date", "id")))
    cards = mails.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), first.alias("subject"))
    return cards.join(who, "thread_id", "left")


def envelopes(mails: DataFrame, bridge: DataFrame, attachments: DataFrame) -> DataFrame:
    """id with attachment_count and the attachments' names in order; messages without one have 0."""
    named = bridge.join(attachments.select("sha256", "size"), "sha256").groupBy(F.col("email_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("filename")).alias("names"), F.sum("size").alias("bytes"))
    rows = mails.join(named, "id", "left")
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("attachment_count"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def earliest_parents(bridge: DataFrame, mails: DataFrame) -> DataFrame:
    """sha256, email_id of the oldest message that carries each content; null dates last."""
    rows = bridge.join(mails.select(F.col("id").alias("email_id"), "date"), "email_id")
    return rows.groupBy("sha256").agg(F.min_by("email_id", F.struct(F.col("date").isNull(), "date", "email_id")).alias("email_id"))


def text_page(text: Column, offset: int, size: int) -> Column:
    """page and whether more follows; an offset past the end gives null."""
    inside = F.length(text) >= offset
    return F.when(inside, F.struct(F.substring(text, offset + 1, size).alias("page"), (F.length(text) > offset + size).alias("truncated")))


def text_context(text: Column, start: Column, end: Column, window: int = 400) -> Column:
    """excerpt, before, after and the excerpt's sha256."""
    low = F.greatest(F.lit(0), start - window)
    cut = F.substring(text, start + 1, end - start)
    return F.struct(cut.alias("excerpt"), F.substring(text, low + 1, start - low).alias("before"), F.substring(text, end + 1, F.lit(window)).alias("after"), F.sha2(cut, 256).alias("sha256"))


def extracted_texts(contents: DataFrame, bridge: DataFrame, accounts: DataFrame | None = None, account: str | None = None) -> DataFrame:
    """Extracted attachments, of an account only those that one of its messages carries."""
    done = contents.filter("status = 'extracted'")
    if account is None:
        return done
    own = bridge.join(accounts.filter(F.col("source_account") == account).select("email_id"), "email_id", "left_semi").select("sha256")
    return done.join(own, "sha256", "left_semi")


def attachment_filter(*, filenames: list[str] | None = None, content_types: list[str] | None = None, min_size: int | None = None, max_size: int | None = None) -> Column:
    """Substrings of names and types are alternatives, fields are ANDed."""
    some = lambda c, values: F.exists(F.array(*(F.lit(v.lower()) for v in values)), lambda v: F.contains(F.lower(c), v))
    out = F.lit(True)
    if filenames:
        out = out & some("filename", filenames)
    if content_types:
        out = out & some("content_type", content_types)
    if min_size is not None:
        out = out & (F.col("size") >= min_size)
    if max_size is not None:
        out = out & (F.col("size") <= max_size)
    return out


def with_status(attachments: DataFrame, contents: DataFrame) -> DataFrame:
    """Attachments with their extraction status; those without a row are pending."""
    rows = attachments.join(contents.select("sha256", F.col("status").alias("_s")), "sha256", "left")
    return rows.withColumn("status", F.coalesce("_s", F.lit("pending"))).drop("_s")


def activity(mails: DataFrame, who: DataFrame, unit: str = "month") -> DataFrame:
    """contact_id, bucket, messages, threads of the messages that each contact's addresses (address, contact_id) sent."""
    rows = mails.filter("date is not null").join(who.select(F.col("address").alias("sender_address"), "contact_id"), "sender_address")
    return rows.groupBy("contact_id", F.date_trunc(unit, "date").alias("bucket")).agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("thread_id").alias("threads"))


def contact_topics(members: DataFrame, mails: DataFrame, who: DataFrame, top: int = 5) -> DataFrame:
    """contact_id, topic, n: the topics (id, topic) that each contact writes most about."""
    rows = mails.select("id", "sender_address").join(members.select("id", "topic"), "id").join(who.select(F.col("address").alias("sender_address"), "contact_id"), "sender_address")
    counts = rows.groupBy("contact_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("contact_id").orderBy(F.desc("n"), "topic")
    return counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).drop("r")


def block_counts(blocks: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    return blocks.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def grouped_results(cards: DataFrame, by: Column, label: str) -> DataFrame:
    """group, size, label (of the best-ranked card), ids in order of rank; for the cards of a ranked window."""
    rows = cards.withColumn("group", by)
    held = F.array_sort(F.collect_list(F.struct("rank", "id", F.col(label).alias("label"))))
    return rows.groupBy("group").agg(held.alias("h")).select("group", F.size("h").alias("size"), F.get("h", F.lit(0))["label"].alias("label"), F.transform("h", lambda x: x["id"]).alias("ids"))


def pseudo_random_sample(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The ``n`` rows with the least md5 of their key: the same ones every time."""
    return rows.orderBy(F.md5(F.col(key).cast("string"))).limit(n)


def import_history(imports: DataFrame, account: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = imports if account is None else imports.filter(F.col("source_account") == account)
    return rows.orderBy(F.col("started_at").desc_nulls_last(), "id").offset(offset).limit(limit)


def hydrated(citations: DataFrame, mails: DataFrame, attachments: DataFrame) -> DataFrame:
    """Citations (source_id) with kind, title and date of what they cite; unknown ids keep nulls."""
    first = mails.groupBy("thread_id").agg(F.min_by(F.struct("subject", "date"), F.struct(F.col("date").isNull(), "date", "id")).alias("f"))
    known = (
        mails.select(F.concat(F.lit("msg_"), "id").alias("source_id"), F.lit("message").alias("kind"), F.col("subject").alias("title"), "date")
        .unionByName(attachments.select(F.concat(F.lit("att_"), "sha256").alias("source_id"), F.lit("attachment").alias("kind"), F.col("filename").alias("title"), F.lit(None).cast("timestamp").alias("date")))
        .unionByName(first.select(F.concat(F.lit("thr_"), "thread_id").alias("source_id"), F.lit("thread").alias("kind"), F.col("f.subject").alias("title"), F.col("f.date").alias("date")))
    )
    return citations.join(known, "source_id", "left")


def known_ids(asked: DataFrame, mails: DataFrame, attachments: DataFrame) -> DataFrame:
    """source_id, found: whether each asked id exists."""
    rows = hydrated(asked.select("source_id").distinct(), mails, attachments)
    return rows.select("source_id", F.col("kind").isNotNull().alias("found"))
