"""Thread cards, envelopes, attachment texts, activity and embedding jobs over the archive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import cards, embedding, health
from lettermill.operators.retrieval import ranked
from lettermill.plans.registry import joined, query, ts
from lettermill.sources import archive

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = archive.attachment_lines(spark, d)
    atts = archive.attachments(lines)
    return atts, archive.bridge(lines), archive.contents(atts)


@query(f", p AS (SELECT thread_id, sender_address AS a FROM emails UNION SELECT thread_id, recipient_address FROM sent_to), w AS (SELECT thread_id, count(*) AS participants FROM p GROUP BY 1) SELECT e.thread_id, count(*) AS messages, {STAMP('min(date)')} AS first_date, {STAMP('max(date)')} AS last_date, first(subject ORDER BY date IS NULL, date, id) AS subject, max(participants) AS participants FROM emails e JOIN w USING (thread_id) GROUP BY 1")
def thread_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards.thread_cards(archive.emails(spark, d)).withColumns({c: ts(c) for c in ("first_date", "last_date")})


@query(", n AS (SELECT b.email_id, count(*) AS n, string_agg(b.filename, '|' ORDER BY b.filename) AS names, sum(size)::BIGINT AS bytes FROM bridge b JOIN attachments USING (sha256) GROUP BY 1) SELECT id, coalesce(n, 0) AS attachment_count, coalesce(names, '') AS names, coalesce(bytes, 0)::BIGINT AS bytes FROM emails LEFT JOIN n ON email_id = id")
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    atts, bridge, _ = _files(spark, d)
    return cards.envelopes(archive.emails(spark, d), bridge, atts).withColumn("names", joined("names"))


@query("SELECT sha256, first(email_id ORDER BY date IS NULL, date, email_id) AS email_id FROM bridge JOIN emails ON id = email_id GROUP BY 1")
def earliest_parents(spark: SparkSession, d: str) -> DataFrame:
    return cards.earliest_parents(_files(spark, d)[1], archive.emails(spark, d))


@query("SELECT doc_id, CASE WHEN length(text) >= 100 THEN substr(text, 101, 50) END AS page, CASE WHEN length(text) >= 100 THEN length(text) > 150 END AS truncated FROM documents", over="tables")
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "documents").select("doc_id", cards.text_page(F.col("text"), 100, 50).alias("p"))
    return rows.select("doc_id", "p.page", "p.truncated")


@query("SELECT doc_id, substr(text, 61, 20) AS excerpt, substr(text, 21, 40) AS before, substr(text, 81, 40) AS after, sha256(substr(text, 61, 20)) AS sha256 FROM documents", over="tables")
def text_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "documents").select("doc_id", cards.text_context(F.col("text"), F.lit(60), F.lit(80), 40).alias("c"))
    return rows.select("doc_id", "c.*")


@query("SELECT sha256 FROM contents WHERE status = 'extracted' AND sha256 IN (SELECT sha256 FROM bridge b JOIN email_accounts a ON a.email_id = b.email_id WHERE a.source_account = 'acct1')")
def extracted_texts(spark: SparkSession, d: str) -> DataFrame:
    _, bridge, contents = _files(spark, d)
    return cards.extracted_texts(contents, bridge, archive.email_accounts(archive.emails(spark, d)), "acct1").select("sha256")


@query("SELECT a.sha256, coalesce(status, 'pending') AS status FROM attachments a LEFT JOIN contents c USING (sha256) WHERE (contains(lower(a.filename), 'ring') OR contains(lower(a.filename), 'widget')) AND (contains(lower(a.content_type), 'pdf') OR contains(lower(a.content_type), 'image')) AND size >= 905")
def attachment_filters(spark: SparkSession, d: str) -> DataFrame:
    atts, _, contents = _files(spark, d)
    rows = atts.filter(cards.attachment_filter(filenames=["RING", "widget"], content_types=["pdf", "image"], min_size=905))
    return cards.with_status(rows, contents).select("sha256", "status")


WHO = "(SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || (c_custkey // 2) AS contact_id FROM customer)"


def _who(spark: SparkSession, d: str) -> DataFrame:
    return archive.read(spark, d, "customer").select(archive.addr(F.col("c_custkey")).alias("address"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)).alias("contact_id"))


@query(f"SELECT contact_id, {STAMP(chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', date)')} AS bucket, count(*) AS messages, count(DISTINCT thread_id) AS threads FROM emails JOIN {WHO} w ON w.address = sender_address WHERE date IS NOT NULL GROUP BY 1, 2")
def contact_activity(spark: SparkSession, d: str) -> DataFrame:
    return cards.activity(archive.emails(spark, d), _who(spark, d)).withColumn("bucket", ts("bucket"))


@query(f"SELECT contact_id, topic, n FROM (SELECT contact_id, (e.id % 12)::INT AS topic, count(*) AS n, row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, e.id % 12) AS r FROM emails e JOIN {WHO} w ON w.address = sender_address GROUP BY 1, 2, e.id % 12) WHERE r <= 5")
def contact_topics(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    return cards.contact_topics(m.select("id", (F.col("id") % 12).cast("int").alias("topic")), m, _who(spark, d))


@query("SELECT conv_id, count(*) AS blocks, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY 1", over="tables")
def block_counts(spark: SparkSession, d: str) -> DataFrame:
    return cards.block_counts(archive.read(spark, d, "conversations"), "conv_id", "role", ["user", "assistant", "system"])


@query(", r AS (SELECT id, subject, source_account, row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS rank FROM emails QUALIFY rank <= 200) SELECT source_account AS \"group\", count(*)::INT AS size, first(subject ORDER BY rank) AS label, string_agg(id::VARCHAR, '|' ORDER BY rank) AS ids FROM r GROUP BY 1")
def grouped_results(spark: SparkSession, d: str) -> DataFrame:
    newest = [F.col("date").desc_nulls_last(), F.asc("id")]
    top = ranked(archive.emails(spark, d).orderBy(*newest).limit(200), *newest)
    rows = cards.grouped_results(top, F.col("source_account"), "subject")
    return rows.withColumn("ids", joined(F.transform("ids", lambda x: x.cast("string"))))


@query("SELECT id FROM emails ORDER BY md5(id::VARCHAR) LIMIT 200")
def sampled_messages(spark: SparkSession, d: str) -> DataFrame:
    return cards.pseudo_random_sample(archive.emails(spark, d), 200).select("id")


@query(f"SELECT import_id AS id, {STAMP('min(date)')} AS started_at, count(*) AS messages_total FROM emails WHERE source_account = 'acct1' GROUP BY 1")
def import_history(spark: SparkSession, d: str) -> DataFrame:
    imports = archive.emails(spark, d).groupBy(F.col("import_id").alias("id"), "source_account").agg(F.min("date").alias("started_at"), F.count(F.lit(1)).alias("messages_total"))
    return cards.import_history(imports, "acct1").select("id", ts("started_at").alias("started_at"), "messages_total")


CITED = ", c AS (SELECT 'msg_' || (conv_id * 7) AS source_id FROM conversations WHERE turn = 0 UNION SELECT 'att_' || md5((conv_id % 200)::VARCHAR) FROM conversations WHERE turn = 0 UNION SELECT 'thr_t' || (conv_id * 50) FROM conversations WHERE turn = 0)"


def _cited(spark: SparkSession, d: str) -> DataFrame:
    c = archive.read(spark, d, "conversations").filter("turn = 0")
    kinds = F.array(F.concat(F.lit("msg_"), F.col("conv_id") * 7), F.concat(F.lit("att_"), F.md5((F.col("conv_id") % 200).cast("string"))), F.concat(F.lit("thr_t"), F.col("conv_id") * 50))
    return c.select(F.explode(kinds).alias("source_id")).distinct()


@query(CITED + ", t AS (SELECT thread_id, first(subject ORDER BY date IS NULL, date, id) AS s FROM emails GROUP BY 1) SELECT source_id, CASE WHEN e.id IS NOT NULL THEN 'message' WHEN a.sha256 IS NOT NULL THEN 'attachment' WHEN t.thread_id IS NOT NULL THEN 'thread' END AS kind, coalesce(e.subject, a.filename, t.s) AS title FROM c LEFT JOIN emails e ON 'msg_' || e.id = source_id LEFT JOIN attachments a ON 'att_' || a.sha256 = source_id LEFT JOIN t ON 'thr_' || t.thread_id = source_id")
def hydrated_citations(spark: SparkSession, d: str) -> DataFrame:
    return cards.hydrated(_cited(spark, d), archive.emails(spark, d), _files(spark, d)[0]).select("source_id", "kind", "title")


@query(CITED + " SELECT source_id, source_id IN (SELECT 'msg_' || id FROM emails UNION SELECT 'att_' || sha256 FROM attachments UNION SELECT 'thr_' || thread_id FROM emails) AS found FROM c")
def known_source_ids(spark: SparkSession, d: str) -> DataFrame:
    return cards.known_ids(_cited(spark, d), archive.emails(spark, d), _files(spark, d)[0])


@query("SELECT content_type, round(avg(extraction_ms), 6) AS extraction_ms, round(avg(n_chunks), 6) AS chunks FROM contents WHERE status = 'extracted' GROUP BY 1")
def extraction_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = health.averages(_files(spark, d)[2])
    return rows.select("content_type", F.round("extraction_ms", 6).alias("extraction_ms"), F.round("chunks", 6).alias("chunks"))


@query()
def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding.embedded(archive.read(spark, d, "documents").select("doc_id", "text"), embedding.hashing_model(), key="doc_id")
    return rows.select("doc_id", "ok", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
