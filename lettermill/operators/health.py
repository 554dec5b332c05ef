"""Data health: coverage, failures, yields, versions of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extraction buckets of content types (fixed values).
ROUTES = {
    "application/pdf": "pdf",
    "application/msword": "doc_legacy",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls_legacy",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/plain": "text",
    "text/html": "html",
    "image/png": "image",
    "image/jpeg": "image",
    "image/jpg": "image",
    "image/gif": "image",
    "image/tiff": "image",
    "image/webp": "image",
    "text/calendar": "calendar",
    "application/ics": "calendar",
    "text/csv": "csv",
    "application/json": "json",
    "application/xml": "xml",
    "text/x-vcard": "vcard",
    "application/x-iwork-pages-sffpages": "pages",
}
#: Buckets that are text already, and the least size of an image (fixed values).
PASSTHROUGH = ("text", "html", "calendar", "csv", "json", "xml", "vcard")
MIN_IMAGE_BYTES = 5 * 1024


def route(content_type: str | Column) -> Column:
    """The extraction bucket, null where the type is not supported."""
    table = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    return F.try_element_at(table, F.lower(content_type))


def archive_summary(mails: DataFrame, attachments: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row: messages, threads, undated, attachments, contacts."""
    m = mails.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("thread_id").alias("threads"), F.count_if(F.col("date").isNull()).alias("undated"))
    count = lambda t, n: t.agg(F.count(F.lit(1)).alias(n))
    return m.crossJoin(count(attachments, "attachments")).crossJoin(count(contacts, "contacts"))


def thread_sizes(mails: DataFrame) -> DataFrame:
    per = mails.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("threads"))


def failure_reasons(contents: DataFrame, top: int = 10) -> DataFrame:
    rows = contents.filter("status = 'failed'").groupBy(F.substring("reason", 1, 120).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "reason").limit(top)


def yields(contents: DataFrame) -> DataFrame:
    """bucket, extracted, failed, skipped, yield_percent (null where nothing was tried)."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = contents.groupBy(F.coalesce(route("content_type"), F.lit("unsupported")).alias("bucket")).agg(n("extracted").alias("extracted"), n("failed").alias("failed"), n("skipped").alias("skipped"))
    tried = F.col("extracted") + F.col("failed")
    return rows.withColumn("yield_percent", F.when(tried > 0, F.round(100 * F.col("extracted") / tried, 1)))


def averages(contents: DataFrame) -> DataFrame:
    """content_type, extraction_ms, chunks: the averages of what was extracted (status, content_type, extraction_ms, n_chunks)."""
    return contents.filter("status = 'extracted'").groupBy("content_type").agg(F.avg("extraction_ms").alias("extraction_ms"), F.avg("n_chunks").alias("chunks"))


def outcome(error: Column, bucket: Column, text: Column, size: Column) -> Column:
    """The status of an extraction: skipped where unsupported, too small or empty, failed on an error, else extracted."""
    small = (bucket == "image") & (size < MIN_IMAGE_BYTES)
    empty = F.coalesce(F.trim(F.replace(text, F.lit("\u0000"), F.lit(""))), F.lit("")) == ""
    return F.when(bucket.isNull() | small, "skipped").when(error.isNotNull(), "failed").when(empty, "skipped").otherwise("extracted")


def pending(attachments: DataFrame, contents: DataFrame, key: str = "sha256") -> DataFrame:
    """Attachments without an extraction row, as pending rows."""
    return attachments.join(contents.select(key), key, "left_anti").withColumn("status", F.lit("pending"))


def skip_empty(contents: DataFrame, chunks: DataFrame, key: str = "sha256") -> DataFrame:
    """Extracted rows that gave no chunk become skipped, with the reason."""
    some = chunks.select(key).distinct().withColumn("has", F.lit(True))
    rows = contents.join(some, key, "left")
    empty = (F.col("status") == "extracted") & F.col("has").isNull()
    return rows.withColumns({"reason": F.when(empty, "empty extraction").otherwise(F.col("reason")), "status": F.when(empty, "skipped").otherwise(F.col("status"))}).drop("has")


def retryable(contents: DataFrame, *, reason_prefix: str | None = None) -> DataFrame:
    """Failed rows to try again: of a reason, or all but hard timeouts."""
    failed = contents.filter("status = 'failed'")
    if reason_prefix is not None:
        return failed.filter(F.col("reason").startswith(reason_prefix))
    return failed.filter(F.col("reason").isNull() | ~F.col("reason").startswith("hard-timeout:"))


def throughput(rows: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """done, rate (a minute), left, eta_minutes (null without progress) of the trailing window (status, extracted_at)."""
    at = F.lit(now).cast("timestamp")
    recent = (F.col("extracted_at") > at - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("extracted_at") <= at)
    counts = rows.agg(F.count_if(recent & (F.col("status") == "extracted")).alias("done"), F.count_if(F.col("status") == "pending").alias("left"))
    rate = F.col("done") / minutes
    return counts.select("done", rate.alias("rate"), "left", F.when(rate > 0, F.col("left") / rate).alias("eta_minutes"))


def data_version(table: DataFrame, stamp: str = "created_at") -> str:
    """A cheap mark that moves whenever rows come: their number and newest stamp."""
    r = table.agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("t")).first()
    return f"{r['n']}-{r['t']}"


def data_versions(tables: dict[str, DataFrame], stamp: str = "created_at") -> DataFrame:
    """name, version of several tables: the number of rows and the newest stamp, an aggregate a table."""
    made = [t.agg(F.concat_ws("-", F.count(F.lit(1)), F.date_format(F.max(stamp), "yyyy-MM-dd HH:mm:ss")).alias("version")).select(F.lit(n).alias("name"), "version") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, made)


def chosen_pending(pending: DataFrame, *, sample: int | None = None, limit: int | None = None, key: str = "sha256", seed: int = 0) -> DataFrame:
    """A random sample of the pending rows, or the first by key, or all of them; ``sample`` goes before ``limit``."""
    if sample is not None:
        return pending.orderBy(F.rand(seed)).limit(sample)
    return pending if limit is None else pending.orderBy(key).limit(limit)


def report(mails: DataFrame, contents: DataFrame, topic_members: DataFrame) -> DataFrame:
    """One row over the archive's health: messages, threads, undated, largest, extracted, failed, missing_vectors, topic_ratio, imports."""
    m = mails.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("date").isNull()).alias("undated"), F.count_if(F.col("embedding").isNull()).alias("missing_vectors"), F.countDistinct("import_id").alias("imports"))
    c = contents.agg(F.count_if(F.col("status") == "extracted").alias("extracted"), F.count_if(F.col("status") == "failed").alias("failed"))
    t = topic_members.select("email_id").distinct().agg(F.count(F.lit(1)).alias("placed"))
    rows = m.crossJoin(thread_sizes(mails).select("threads", "largest")).crossJoin(c).crossJoin(t)
    ratio = F.when(F.col("messages") > 0, F.col("placed") / F.col("messages"))
    return rows.select("messages", "threads", "undated", "largest", "extracted", "failed", "missing_vectors", ratio.alias("topic_ratio"), "imports")


def passthrough_text(content: Column, bucket: Column) -> Column:
    """The text of types that are text already, decoded as UTF-8 with U+FFFD for broken bytes; null for the others."""
    return F.when(bucket.isin(*PASSTHROUGH), F.make_valid_utf8(content.cast("string")))


def read_texts(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """path, bucket, text, size of each file under a folder that is not empty.

    Files that are text already, by the content type of their extension, are decoded; the others have no text here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    kind = F.try_element_at(table, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)))
    return files.select("path", route(kind).alias("bucket"), "content", F.col("length").alias("size")).select("path", "bucket", passthrough_text(F.col("content"), F.col("bucket")).alias("text"), "size")
