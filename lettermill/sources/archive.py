"""The archive's tables as views over the supplied star schema, and the same views as SQL for the oracles.

An order is a message: its customer sends it, its lines name the recipients by return flag and carry the attachments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addr(k: Column) -> Column:
    return F.concat(F.lit("u"), k.cast("string"), F.lit("@d"), (k % 5).cast("string"), F.lit(".example"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their heavy columns."""
    n = read(spark, sf_dir, "customer").count()
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", addr(F.col("l_partkey") % n).alias("a"), "l_quantity")
    arm = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("a"))))
    sent = lines.groupBy("id").agg(arm("N").alias("to"), arm("A").alias("cc"), arm("R").alias("bcc"), F.max((F.col("l_quantity") >= 45).cast("int")).alias("att"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sender_name"))
    none = F.array().cast("array<string>")
    i = F.col("id")
    linked = (i >= 4000) & (i % 5 != 0)
    return (
        orders.join(names, "o_custkey", "left")
        .join(sent, "id", "left")
        .select(
            "id",
            F.concat(F.lit("m"), i).alias("message_id"),
            F.concat(F.lit("t"), i % 4000).alias("thread_id"),
            addr(F.col("o_custkey")).alias("sender_address"),
            F.concat(F.lit("d"), F.col("o_custkey") % 5, F.lit(".example")).alias("sender_domain"),
            "sender_name",
            F.when(i % 97 != 0, F.col("o_orderdate").cast("timestamp")).alias("date"),
            F.concat(F.when(i % 4 == 0, "Re: ").otherwise(""), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")).alias("subject"),
            F.struct(*(F.coalesce(F.col(c), none).alias(c) for c in ("to", "cc", "bcc"))).alias("recipients"),
            (F.coalesce("att", F.lit(0)) == 1).alias("has_attachment"),
            F.array("o_orderpriority", "o_orderstatus").alias("labels"),
            F.when(linked, F.concat(F.lit("m"), i - 4000)).alias("in_reply_to"),
            F.concat(F.lit("acct"), i % 3).alias("source_account"),
            F.concat(F.lit("imp"), i % 4).alias("import_id"),
        )
    )


def with_bodies(mails: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("b_id"), F.col("text").alias("body_text"))
    n = docs.count()
    return mails.withColumn("b_id", F.col("id") % n).join(docs, "b_id", "left").drop("b_id")


def with_vectors(mails: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v_id"), "embedding")
    n = vectors.count()
    return mails.withColumn("v_id", F.col("id") % n).join(vectors, "v_id", "left").drop("v_id")


def email_accounts(mails: DataFrame) -> DataFrame:
    own = mails.select(F.col("id").alias("email_id"), F.col("source_account"), "import_id")
    more = mails.filter("id % 11 = 0").select(F.col("id").alias("email_id"), F.concat(F.lit("acct"), (F.col("id") + 1) % 3).alias("source_account"), "import_id")
    return own.unionAll(more)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive owner's addresses."""
    return read(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(addr(F.col("c_custkey")).alias("address"))


def attachment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each attachment of a message: email_id, sha256, filename, content_type, size."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("application/pdf", "image/png", "text/csv", "application/msword", "application/zip"))), (F.col("p_size") % 5 + 1).cast("int"))
    lines = read(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_partkey")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("email_id"),
        F.md5((F.col("l_partkey") % 150).cast("string")).alias("sha256"),
        F.concat(F.col("p_name"), F.lit("_v"), F.col("p_size") % 3, F.lit(".pdf")).alias("filename"),
        kinds.alias("content_type"),
        F.floor("p_retailprice").cast("long").alias("size"),
    )


def attachments(lines: DataFrame) -> DataFrame:
    """One row for each content: the first by (filename, content_type, size), and how many messages refer to it."""
    return lines.groupBy("sha256").agg(F.min(F.struct("filename", "content_type", "size")).alias("a"), F.countDistinct("email_id").alias("reference_count")).select("sha256", "a.*", "reference_count")


def bridge(lines: DataFrame) -> DataFrame:
    return lines.groupBy("email_id", "sha256").agg(F.min("filename").alias("filename"))


def contents(atts: DataFrame) -> DataFrame:
    """Extraction results: made from the content key, so that every status occurs."""
    n = F.conv(F.substring("sha256", 1, 6), 16, 10).cast("long")
    status = F.when(n % 10 < 6, "extracted").when(n % 10 < 8, "failed").when(n % 10 < 9, "skipped")
    reason = F.when(status == "failed", F.when(n % 3 == 0, "timed out after 60 s").when(n % 3 == 1, "hard-timeout: 300 s").otherwise("bad file")).when(status == "skipped", "too small")
    return atts.select("sha256", "filename", "content_type", status.alias("status"), reason.alias("reason"), (n % 5000).alias("extraction_ms"), (n % 7).alias("n_chunks")).filter("status is not null")


#: The same views for DuckDB; an oracle puts its own query after them.
SQL = """WITH nc AS (SELECT count(*) AS n FROM customer),
rcp AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS f, 'u' || (l_partkey % n) || '@d' || ((l_partkey % n) % 5) || '.example' AS a FROM lineitem, nc),
arms AS (SELECT id, list_sort(list(a) FILTER (f = 'N')) AS t, list_sort(list(a) FILTER (f = 'A')) AS c, list_sort(list(a) FILTER (f = 'R')) AS b FROM rcp GROUP BY id),
att AS (SELECT l_orderkey AS id, max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS att FROM lineitem GROUP BY 1),
emails AS (SELECT o_orderkey AS id, 'm' || o_orderkey AS message_id, 't' || (o_orderkey % 4000) AS thread_id,
  'u' || o_custkey || '@d' || (o_custkey % 5) || '.example' AS sender_address, 'd' || (o_custkey % 5) || '.example' AS sender_domain, c_name AS sender_name,
  CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS date,
  (CASE WHEN o_orderkey % 4 = 0 THEN 'Re: ' ELSE '' END) || o_orderpriority || ' ' || o_orderstatus AS subject,
  coalesce(t, []::VARCHAR[]) AS to_l, coalesce(c, []::VARCHAR[]) AS cc_l, coalesce(b, []::VARCHAR[]) AS bcc_l,
  coalesce(att, 0) = 1 AS has_attachment, [o_orderpriority, o_orderstatus] AS labels,
  CASE WHEN o_orderkey >= 4000 AND o_orderkey % 5 <> 0 THEN 'm' || (o_orderkey - 4000) END AS in_reply_to,
  'acct' || (o_orderkey % 3) AS source_account, 'imp' || (o_orderkey % 4) AS import_id
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN arms ON arms.id = o_orderkey LEFT JOIN att ON att.id = o_orderkey),
bodies AS (SELECT e.id, d.text AS body_text FROM emails e LEFT JOIN documents d ON d.doc_id = e.id % (SELECT count(*) FROM documents)),
vectors AS (SELECT e.id, v.embedding::DOUBLE[] AS v FROM emails e LEFT JOIN embeddings v ON v.vec_id = e.id % (SELECT count(*) FROM embeddings)),
email_accounts AS (SELECT id AS email_id, source_account, import_id FROM emails UNION ALL SELECT id, 'acct' || ((id + 1) % 3), import_id FROM emails WHERE id % 11 = 0),
me AS (SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address FROM customer WHERE c_custkey % 7 = 0),
sent_to AS (SELECT e.id, e.thread_id, e.date, e.sender_address, e.sender_domain, r.a AS recipient_address, split_part(r.a, '@', 2) AS recipient_domain, CASE r.f WHEN 'N' THEN 'to' WHEN 'A' THEN 'cc' ELSE 'bcc' END AS recipient_type FROM emails e JOIN rcp r ON r.id = e.id),
attl AS (SELECT l_orderkey AS email_id, md5((l_partkey % 150)::VARCHAR) AS sha256, p_name || '_v' || (p_size % 3) || '.pdf' AS filename,
  (['application/pdf', 'image/png', 'text/csv', 'application/msword', 'application/zip'])[p_size % 5 + 1] AS content_type, floor(p_retailprice)::BIGINT AS size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 45),
attachments AS (SELECT sha256, a.filename AS filename, a.content_type AS content_type, a.size AS size, n AS reference_count FROM (SELECT sha256, min({'filename': filename, 'content_type': content_type, 'size': size}) AS a, count(DISTINCT email_id) AS n FROM attl GROUP BY sha256)),
bridge AS (SELECT email_id, sha256, min(filename) AS filename FROM attl GROUP BY 1, 2),
contents0 AS (SELECT *, ('0x' || substr(sha256, 1, 6))::BIGINT AS n FROM attachments),
contents AS (SELECT sha256, filename, content_type, CASE WHEN n % 10 < 6 THEN 'extracted' WHEN n % 10 < 8 THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN n % 10 < 6 THEN NULL WHEN n % 10 < 8 THEN CASE n % 3 WHEN 0 THEN 'timed out after 60 s' WHEN 1 THEN 'hard-timeout: 300 s' ELSE 'bad file' END ELSE 'too small' END AS reason,
  n % 5000 AS extraction_ms, n % 7 AS n_chunks FROM contents0 WHERE n % 10 < 9)
"""
