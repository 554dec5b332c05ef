"""Topics, bursts, events, evidence, text jobs, files, health and streams over the archive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.operators import events, files, health, redaction, rollups, topics
from lettermill.plans.registry import ORACLES, joined, query, ts
from lettermill.sources import archive, mailbox, sinks
from lettermill.staging import fresh_path, staged


def _vector_mails(spark: SparkSession, d: str) -> DataFrame:
    return archive.with_vectors(archive.emails(spark, d), spark, d)


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return archive.read(spark, d, "embeddings").filter("vec_id < 8").select(F.col("vec_id").cast("int").alias("topic"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))


NEAR = ", c AS (SELECT vec_id::INT AS topic, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 8), placed AS (SELECT id, arg_min(topic, (1 - list_cosine_similarity(v, c), topic)) AS topic, min(1 - list_cosine_similarity(v, c)) AS distance FROM vectors, c GROUP BY id)"


@query(NEAR + " SELECT id, topic, round(distance, 6) AS distance FROM placed")
def topic_assignment(spark: SparkSession, d: str) -> DataFrame:
    return topics.assign(_vector_mails(spark, d), _centroids(spark, d)).select("id", "topic", F.round("distance", 6).alias("distance"))


@query(NEAR + ", river AS (SELECT topic, date_trunc('quarter', date) AS b, count(*) AS n FROM placed JOIN emails USING (id) WHERE date IS NOT NULL GROUP BY 1, 2) SELECT topic, strftime(b, '%Y-%m-%d') AS bucket, n FROM river WHERE topic IN (SELECT topic FROM river GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 6)")
def topic_river(spark: SparkSession, d: str) -> DataFrame:
    from lettermill.operators.timeline import top_series

    m = _vector_mails(spark, d)
    placed = topics.assign(m, _centroids(spark, d)).join(m.select("id", "date"), "id")
    return top_series(placed, "topic", "quarter", 6).select("topic", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n")


@query(NEAR + ", r AS (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY round(distance, 6), date DESC NULLS LAST, id) AS rank FROM placed JOIN emails USING (id)) SELECT topic AS topic_id, id AS email_id, rank::INT AS rank FROM r WHERE rank <= 5")
def topic_representatives(spark: SparkSession, d: str) -> DataFrame:
    m = _vector_mails(spark, d)
    placed = topics.assign(m, _centroids(spark, d)).join(m.select("id", "date"), "id")
    members = placed.select(F.col("topic").alias("topic_id"), F.col("id").alias("email_id"), F.round("distance", 6).alias("distance"), "date")
    return topics.representatives(members).select("topic_id", "email_id", "rank")


@query(", t AS (SELECT source_account AS topic, unnest(regexp_extract_all(lower(subject), '[a-z0-9]+')) AS term FROM emails), c AS (SELECT topic, term, count(*) AS n FROM t WHERE length(term) >= 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM c WHERE term NOT IN ('not', 'the')) SELECT topic, string_agg(term, '|' ORDER BY r) AS terms FROM r WHERE r <= 5 GROUP BY 1")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.emails(spark, d).select(F.col("source_account").alias("topic"), "subject")
    return topics.top_terms(rows).select("topic", joined("terms").alias("terms"))


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return topics.cluster(rows, 10)[0]


@query()
def topic_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    return topics.projection(rows, "id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))




@query("WITH m AS (SELECT 't' || n_regionkey AS topic_id, n_nationkey AS e FROM nation), k AS (SELECT topic_id, count(*) AS n FROM m GROUP BY 1), f AS (SELECT 'n' || (c_custkey % 4) AS topic_id, count(*) AS n FROM customer GROUP BY 1) SELECT topic_id AS id, CASE topic_id WHEN 't0' THEN 'curated' ELSE 'automatic' END AS origin, 1 AS generation, n AS member_count FROM k WHERE topic_id IN ('t0', 't1', 't2') UNION ALL SELECT topic_id, 'automatic', 2, n FROM f", over="tables")
def topic_regeneration(spark: SparkSession, d: str) -> DataFrame:
    n = archive.read(spark, d, "nation")
    old = archive.read(spark, d, "region").select(F.concat(F.lit("t"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.when(F.col("r_regionkey") == 0, "curated").otherwise("automatic").alias("origin"), F.lit(None).cast("string").alias("parent_id"), (F.col("r_regionkey") == 1).alias("hidden"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(None).cast("array<string>").alias("top_terms"), F.lit(1).alias("generation"), F.lit(0).alias("member_count"))
    members = n.select(F.concat(F.lit("t"), "n_regionkey").alias("topic_id"), F.col("n_nationkey").cast("string").alias("email_id"), F.lit(0.5).alias("distance"), F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") < 10), "manual").otherwise("automatic").alias("origin"))
    c = archive.read(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_custkey") % 4).alias("topic_id"), F.col("c_custkey").cast("string").alias("email_id"), F.lit(0.1).alias("distance"))
    fresh = c.select(F.col("topic_id").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(None).cast("array<string>").alias("top_terms"))
    rows, _ = topics.regenerate(old, members, fresh, c)
    return rows.select("id", "origin", "generation", "member_count")


def _days(spark: SparkSession, d: str) -> DataFrame:
    return events.day_counts(archive.read(spark, d, "events").select(F.col("event_type"), F.col("ts").cast("timestamp").alias("date"), "event_id", "user_id"), "event_type")


DAYS = "WITH days AS (SELECT event_type AS series, ts::DATE AS day, count(*) AS cnt FROM events GROUP BY 1, 2)"


@query(DAYS + " SELECT series, strftime(day, '%Y-%m-%d') AS day, cnt FROM days", over="tables")
def day_counts(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d).select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), "cnt")


BURSTS = (
    ", volume AS (SELECT sender_domain || '/' || source_account AS series, date::DATE AS day, count(*) AS cnt FROM emails WHERE date IS NOT NULL GROUP BY 1, 2)"
    ", usual AS (SELECT series, avg(cnt) AS m, stddev_pop(cnt) AS s FROM volume GROUP BY 1)"
    ", spikes AS (SELECT series, day FROM volume JOIN usual USING (series) WHERE cnt >= CASE WHEN s < 1e-12 THEN greatest(m * 2, 5) ELSE m + 2 * s END)"
    ", isl AS (SELECT series, day, sum(new) OVER (PARTITION BY series ORDER BY day) AS g FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY series ORDER BY day) <= 3 THEN 0 ELSE 1 END AS new FROM spikes))"
    ", win AS (SELECT series, min(day) - 1 AS burst_start, max(day) + 1 AS burst_end FROM isl GROUP BY series, g)"
    ", tot AS (SELECT w.series, burst_start, burst_end, sum(cnt)::BIGINT AS total FROM win w JOIN volume s ON s.series = w.series AND s.day BETWEEN burst_start AND burst_end GROUP BY 1, 2, 3)"
    ", best AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY total DESC, burst_start) AS rank FROM tot QUALIFY rank <= 20)"
)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return archive.emails(spark, d).withColumn("series", F.concat_ws("/", "sender_domain", "source_account"))


@query(BURSTS + " SELECT series, strftime(burst_start, '%Y-%m-%d') AS burst_start, strftime(burst_end, '%Y-%m-%d') AS burst_end, total, rank::INT AS rank FROM best")
def burst_windows(spark: SparkSession, d: str) -> DataFrame:
    found = events.bursts(events.day_counts(_series(spark, d), "series"))
    return found.select("series", F.date_format("burst_start", "yyyy-MM-dd").alias("burst_start"), F.date_format("burst_end", "yyyy-MM-dd").alias("burst_end"), "total", "rank")


@query(BURSTS + ", hits AS (SELECT b.series, burst_start, e.id, row_number() OVER (PARTITION BY b.series, burst_start ORDER BY e.date, e.id) AS rank FROM best b JOIN emails e ON e.sender_domain || '/' || e.source_account = b.series AND e.date::DATE BETWEEN burst_start AND burst_end) SELECT series, strftime(burst_start, '%Y-%m-%d') AS burst_start, id, rank::INT AS rank FROM hits WHERE rank <= 10")
def burst_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d)
    found = events.burst_sources(events.bursts(events.day_counts(rows, "series")), rows, "series")
    return found.select("series", F.date_format("burst_start", "yyyy-MM-dd").alias("burst_start"), "id", "rank")


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = archive.read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.concat(F.lit("see [S"), F.col("turn") % 3, F.lit("] and [S"), F.length("text") % 4, F.lit("], again [S"), F.col("turn") % 3, F.lit("]")).alias("text"))
    sources = rows.select("answer_id", F.explode(F.array(F.lit("S0"), F.lit("S1"))).alias("marker")).withColumn("source_id", F.concat(F.lit("msg_"), "answer_id", "marker"))
    return rows, sources


SAID = "WITH a AS (SELECT conv_id || '-' || turn AS answer_id, 'S' || (turn % 3) AS m1, 'S' || (length(text) % 4) AS m2 FROM conversations)"


@query(SAID + ", m AS (SELECT answer_id, 0 AS pos, m1 AS marker FROM a UNION ALL SELECT answer_id, 1, m2 FROM a WHERE m2 <> m1) SELECT answer_id, pos, marker, CASE WHEN marker IN ('S0', 'S1') THEN 'msg_' || answer_id || marker END AS source_id FROM m", over="tables")
def resolved_citations(spark: SparkSession, d: str) -> DataFrame:
    return events.resolve_citations(*_answers(spark, d)).select("answer_id", "pos", "marker", "source_id")


@query("SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_start FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-12' AND ts + INTERVAL 2 HOUR >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id::VARCHAR LIMIT 301", over="tables")
def events_in_viewport(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("time_start"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("time_end"), F.when(F.col("event_type") == "error", "dismissed").otherwise("unreviewed").alias("status"))
    return events.in_viewport(rows, "2024-01-10", "2024-01-12", limit=300).select("id", ts("time_start").alias("time_start"))


STATUSES = "CASE o_orderkey % 5 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'superseded' ELSE 'edited' END"


@query(f"WITH e AS (SELECT o_orderkey AS k, {STATUSES} AS s, (['confirmed', 'dismissed', 'unreviewed', 'edited', 'gone'])[(o_orderkey // 5) % 5 + 1] AS target FROM orders) SELECT 'e' || k AS event_id, target, CASE WHEN k % 13 = 0 THEN 'conflict' WHEN (target = 'confirmed' AND s NOT IN ('dismissed', 'superseded')) OR (target = 'dismissed' AND s <> 'superseded') OR (target = 'unreviewed' AND s = 'dismissed') OR target = 'edited' THEN 'accepted' ELSE 'rejected' END AS verdict FROM e", over="tables")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % 5 + 1).cast("int"))
    o = archive.read(spark, d, "orders")
    rows = o.select(F.concat(F.lit("e"), k).alias("id"), pick(k, "unreviewed", "confirmed", "dismissed", "superseded", "edited").alias("status"), F.lit(2).alias("current_version"))
    changes = o.select(F.concat(F.lit("e"), k).alias("event_id"), pick(F.floor(k / 5), "confirmed", "dismissed", "unreviewed", "edited", "gone").alias("target"), F.when(k % 13 == 0, 1).alias("expected_version"))
    return events.transitions(rows, changes)


FAMILY = (
    ", ranked AS (SELECT a.sha256, a.filename, e.id, e.sender_address, e.thread_id, row_number() OVER (PARTITION BY a.sha256 ORDER BY e.date DESC NULLS LAST, e.id DESC, a.filename) AS r FROM bridge a JOIN emails e ON e.id = a.email_id)"
    ", f AS (SELECT id || ':' || sha256 AS key, sha256, regexp_replace(regexp_replace(lower(filename), '\\.pdf$', ''), '_v[0-9]+$', '') AS stem, e.id, e.sender_address, e.thread_id FROM bridge b JOIN emails e ON e.id = b.email_id)"
)


@query(FAMILY + " SELECT a.key AS a, b.key AS b, CASE WHEN a.sha256 = b.sha256 THEN 'exact-duplicate' ELSE 'probable-version' END AS confidence FROM f a JOIN f b ON a.stem = b.stem AND (a.sender_address = b.sender_address OR a.thread_id = b.thread_id) WHERE a.id % 100 = 0")
def version_families(spark: SparkSession, d: str) -> DataFrame:
    """A search: the files of every message whose id is divisible by 100 are asked for, against all files."""
    rows = _family_files(spark, d)
    return files.families(rows, asked=rows.filter("email_id % 100 = 0")).select("a", "b", "confidence")


def _family_files(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d).select(F.col("id").alias("email_id"), "sender_address", "thread_id")
    rows = archive.bridge(archive.attachment_lines(spark, d)).join(m, "email_id")
    return rows.select("email_id", F.concat_ws(":", "email_id", "sha256").alias("key"), "sha256", "filename", "sender_address", "thread_id")


@query(
    FAMILY
    + ", rows AS (SELECT f.*, e.date, a.content_type, coalesce(c.status, 'pending') AS status FROM f JOIN emails e ON e.id = f.id JOIN attachments a ON a.sha256 = f.sha256 LEFT JOIN contents c ON c.sha256 = f.sha256 WHERE e.date >= '1995-01-01' AND e.sender_address LIKE '%@d1.example' AND a.content_type IN ('text/csv', 'application/vnd.ms-excel'))"
    ", ordered AS (SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, id DESC, sha256) AS r FROM rows)"
    " SELECT key, status, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, (SELECT count(*) FROM bridge b WHERE b.sha256 = o.sha256) AS duplicates, (SELECT count(*) FROM f x WHERE x.stem = o.stem AND (x.sender_address = o.sender_address OR x.thread_id = o.thread_id)) AS family_count FROM ordered o WHERE r <= 60"
)
def file_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of the spreadsheets of a domain's senders, the second after the last row of the first."""
    lines, mails = archive.attachment_lines(spark, d), archive.emails(spark, d).select("id", "date", "sender_address", "sender_domain", "thread_id")
    atts = archive.attachments(lines)
    given = (archive.bridge(lines), atts, archive.contents(atts), mails)
    how = {"scope": (F.col("date") >= "1995-01-01") & (F.col("sender_domain") == "d1.example"), "family": "spreadsheet"}
    one = staged(files.page(*given, **how, limit=30), "first")
    last = one.orderBy(F.asc_nulls_first("date"), "email_id", F.desc("sha256")).first()
    two = files.page(*given, **how, limit=30, after=(last["date"], last["email_id"], last["sha256"])) if last else one
    return one.unionAll(two).distinct().select("key", "status", ts("date").alias("date"), "duplicates", "family_count")


@query()
def file_families(spark: SparkSession, d: str) -> DataFrame:
    return files.family_members(_family_files(spark, d)).select("key", "family")


@query(FAMILY + " SELECT sha256, id AS email_id, filename FROM ranked WHERE r = 1")
def newest_parents(spark: SparkSession, d: str) -> DataFrame:
    rows = files.newest_parent(archive.bridge(archive.attachment_lines(spark, d)), archive.emails(spark, d))
    return rows.select("sha256", "email_id", "filename")


@query(", d AS (SELECT sha256, count(*) AS duplicates FROM bridge GROUP BY 1), r AS (SELECT b.sha256, b.email_id, row_number() OVER (PARTITION BY b.sha256 ORDER BY e.date DESC NULLS LAST, e.id DESC) AS r FROM bridge b JOIN emails e ON e.id = b.email_id) SELECT sha256, duplicates, string_agg(email_id::VARCHAR, '|' ORDER BY r) AS occurrences FROM r JOIN d USING (sha256) WHERE r <= 20 GROUP BY 1, 2")
def attachment_list(spark: SparkSession, d: str) -> DataFrame:
    rows = files.listing(archive.bridge(archive.attachment_lines(spark, d)), archive.emails(spark, d), one_a_hash=True)
    return rows.select("sha256", "duplicates", joined(F.transform("occurrences", lambda x: x.cast("string"))).alias("occurrences"))


@query("SELECT p_partkey AS id, regexp_replace(p_name || '_Final_v' || p_size || '.PDF', '_Final_v[0-9]+\\.PDF$', '') AS stem FROM part", over="tables")
def filename_stems(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("_Final_v"), "p_size", F.lit(".PDF"))
    return archive.read(spark, d, "part").select(F.col("p_partkey").alias("id"), files.filename_stem(name).alias("stem"))


@query("WITH p AS (SELECT doc_id AS key, list_distinct(string_split(text, chr(10))) AS n, lag(list_distinct(string_split(text, chr(10)))) OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents) SELECT key, len(list_filter(n, lambda x: NOT list_contains(o, x)))::BIGINT AS added, len(list_filter(o, lambda x: NOT list_contains(n, x)))::BIGINT AS removed FROM p WHERE o IS NOT NULL", over="tables")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.changed_lines(_versions(spark, d)).select("key", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside the one before it of the same source."""
    docs = archive.read(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return files.versions(docs, "source").filter("old is not null")


@query()
def line_diffs(spark: SparkSession, d: str) -> DataFrame:
    diffs = files.line_diff(_versions(spark, d))
    return diffs.select("key", F.size("hunks").alias("hunks"), "truncated")


@query("SELECT (SELECT count(*) FROM emails) AS messages, (SELECT count(DISTINCT thread_id) FROM emails) AS threads, (SELECT count(*) FROM emails WHERE date IS NULL) AS undated, (SELECT count(*) FROM attachments) AS attachments, (SELECT count(*) FROM customer) AS contacts")
def archive_summary(spark: SparkSession, d: str) -> DataFrame:
    return health.archive_summary(archive.emails(spark, d), archive.attachments(archive.attachment_lines(spark, d)), archive.read(spark, d, "customer"))


def _rolled(spark: SparkSession, d: str) -> str:
    """The partial aggregates of the archive's four imports."""
    root = fresh_path(spark, "rollups")
    mails, bridge, me = archive.emails(spark, d), archive.bridge(archive.attachment_lines(spark, d)), staged(archive.identities(spark, d), "me")
    mails = staged(mails, "mails")
    for i in range(4):
        rollups.add_import(root, f"imp{i}", "1", mails.filter(F.col("import_id") == f"imp{i}"), bridge, me)
    return root


@query(ORACLES["archive_summary"].removeprefix(archive.SQL))
def rolled_summary(spark: SparkSession, d: str) -> DataFrame:
    """``archive_summary`` from the imports' partial aggregates."""
    return rollups.summary(spark, _rolled(spark, d), archive.read(spark, d, "customer"))


@query("SELECT address AS key, count(*) AS messages FROM (SELECT sender_address AS address FROM emails UNION ALL SELECT recipient_address FROM sent_to WHERE sender_address IN (SELECT address FROM me)) WHERE address NOT IN (SELECT address FROM me) GROUP BY 1")
def rolled_contacts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top_contacts(rollups.partials(spark, _rolled(spark, d), "met"), archive.identities(spark, d))


@query("SELECT 'messages' AS lane, strftime(date_trunc('quarter', date), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM emails WHERE date >= '1995-01-01' AND date < '1998-07-01' GROUP BY 2 UNION ALL SELECT 'attachments', strftime(date_trunc('quarter', date), '%Y-%m-%d %H:%M:%S'), count(*) FROM bridge b JOIN emails e ON e.id = b.email_id WHERE date >= '1995-01-01' AND date < '1998-07-01' GROUP BY 2 UNION ALL SELECT 'density', strftime(date_trunc('quarter', date), '%Y-%m-%d %H:%M:%S'), count(*) FROM emails WHERE date IS NOT NULL GROUP BY 2")
def rolled_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The exact lanes of stored days; the estimated one, people, has a test of its own."""
    days = rollups.partials(spark, _rolled(spark, d), "days")
    return rollups.lanes(days, unit="quarter", after="1995-01-01", before="1998-07-01").filter("lane <> 'people'").select("lane", ts("bucket").alias("bucket"), "n")


@query("SELECT count(*) FILTER (n = 1) AS single, max(n) AS largest, count(*) AS threads FROM (SELECT count(*) AS n FROM emails GROUP BY thread_id)")
def thread_sizes(spark: SparkSession, d: str) -> DataFrame:
    return health.thread_sizes(archive.emails(spark, d))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return archive.contents(archive.attachments(archive.attachment_lines(spark, d)))


@query("SELECT substr(reason, 1, 120) AS reason, count(*) AS n FROM contents WHERE status = 'failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return health.failure_reasons(_contents(spark, d))


@query(", c AS (SELECT CASE content_type WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image' WHEN 'text/csv' THEN 'csv' WHEN 'application/msword' THEN 'doc_legacy' ELSE 'unsupported' END AS bucket, status FROM contents) SELECT bucket, count(*) FILTER (status = 'extracted') AS extracted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CASE WHEN count(*) FILTER (status <> 'skipped') > 0 THEN round(100 * count(*) FILTER (status = 'extracted') / count(*) FILTER (status <> 'skipped'), 1)::DOUBLE END AS yield_percent FROM c GROUP BY 1")
def extraction_yields(spark: SparkSession, d: str) -> DataFrame:
    return health.yields(_contents(spark, d))


@query("SELECT sha256 FROM attachments WHERE sha256 NOT IN (SELECT sha256 FROM contents)")
def pending_attachments(spark: SparkSession, d: str) -> DataFrame:
    atts = archive.attachments(archive.attachment_lines(spark, d))
    return health.pending(atts, archive.contents(atts)).select("sha256")


@query("SELECT sha256, CASE WHEN status = 'extracted' AND n_chunks = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN status = 'extracted' AND n_chunks = 0 THEN 'empty extraction' ELSE reason END AS reason FROM contents")
def skipped_empty(spark: SparkSession, d: str) -> DataFrame:
    c = _contents(spark, d)
    return health.skip_empty(c, c.filter("n_chunks > 0").select("sha256")).select("sha256", "status", "reason")


@query("SELECT sha256, reason FROM contents WHERE status = 'failed' AND reason NOT LIKE 'hard-timeout:%'")
def retryable_attachments(spark: SparkSession, d: str) -> DataFrame:
    return health.retryable(_contents(spark, d)).select("sha256", "reason")


@query("SELECT count(*) FILTER (event_type <> 'error' AND ts > TIMESTAMP '2024-01-10' - INTERVAL 600 MINUTE AND ts <= TIMESTAMP '2024-01-10') AS done, round(count(*) FILTER (event_type <> 'error' AND ts > TIMESTAMP '2024-01-10' - INTERVAL 600 MINUTE AND ts <= TIMESTAMP '2024-01-10') / 600, 9)::DOUBLE AS rate, count(*) FILTER (event_type = 'error') AS \"left\" FROM events", over="tables")
def extraction_throughput(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "events").select(F.when(F.col("event_type") == "error", "pending").otherwise("extracted").alias("status"), F.col("ts").cast("timestamp").alias("extracted_at"))
    return health.throughput(rows, "2024-01-10", 600).select("done", F.round("rate", 9).alias("rate"), "left")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)src\\s*=|background\\s*=|url\\s*\\('))::INT AS remote, regexp_matches(html, '(?i)<\\s*(?:script|iframe|object|embed|form)\\b') OR regexp_matches(html, '(?i)\\bon\\w+\\s*=') AS active, md5(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' ')) AS text_md5 FROM pages", over="tables")
def page_markup(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "pages")
    return rows.select("page_id", text.remote_references("html").alias("remote"), text.active_content("html").alias("active"), F.md5(text.plain_text(F.lit(None).cast("string"), F.col("html"))).alias("text_md5"))


@query()
def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return redaction.cleaned(archive.read(spark, d, "pages").select("page_id", "html")).select("page_id", F.length("clean").alias("clean_chars"), F.length("plain").alias("plain_chars"))


@query()
def pii_report(spark: SparkSession, d: str) -> DataFrame:
    rows = redaction.with_spans(archive.read(spark, d, "documents").select("doc_id", "text"))
    return redaction.span_report(rows, "doc_id")[0]


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = redaction.redacted(redaction.with_spans(archive.read(spark, d, "documents").select("doc_id", "text")))
    return rows.select("doc_id", F.size("spans").alias("n_spans"), F.md5("redacted").alias("redacted_md5"))


SCRUB = "regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '[REDACTED-EMAIL]', 'g'), '\\b\\d{3}-\\d{2}-\\d{4}\\b', '[REDACTED-SSN]', 'g'), '\\b\\d{3}[-.]?\\d{3}[-.]?\\d{4}\\b', '[REDACTED-PHONE]', 'g')"


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), s AS (SELECT doc_id, {SCRUB} AS t FROM l WHERE NOT regexp_matches(text, '\\b\\d{{13,19}}\\b')) SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS scrubbed, count(*) AS n FROM s WHERE t LIKE '%[REDACTED%' GROUP BY 1, 2", over="tables")
def scrubbed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = archive.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(~F.col("line").rlike(text.CARD))
    hit = F.col("line").rlike(text.EMAIL) | F.col("line").rlike(text.SSN) | F.col("line").rlike(text.PHONE)
    return lines.filter(hit).select("doc_id", text.scrubbed("line").alias("scrubbed")).groupBy("doc_id", "scrubbed").agg(F.count(F.lit(1)).alias("n"))


@query()
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("markdown"))
    return redaction.chunked(rows, "doc_id", most=200, least=40).select("doc_id", "chunk_index", "heading_path", "token_count")


@query("SELECT id, thread, unpadded FROM (SELECT id, 'thr_' || rtrim(replace(replace(to_base64(thread_id::BLOB), '+', '-'), '/', '_'), '=') AS thread, 'msg_' || id AS unpadded FROM emails)")
def opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    return archive.emails(spark, d).select("id", text.source_id("thread", F.col("thread_id")).alias("thread"), text.source_id("message", F.col("id")).alias("unpadded"))


CLEAN = (
    ", q AS (SELECT id, string_split(CASE id % 4 WHEN 0 THEN '> said' || chr(10) ELSE '' END || coalesce(body_text, '') || CASE id % 5 WHEN 0 THEN chr(10) || '-- ' || chr(10) || 'me' WHEN 1 THEN chr(10) || ' -----Original Message-----  ' || chr(10) || 'old' WHEN 2 THEN chr(10) || '> quoted' ELSE '' END, chr(10)) AS l FROM bodies)"
    ", s AS (SELECT id, l, list_position(list_transform(l, lambda x: trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'), ' ')), '-----Original Message-----') AS stop FROM q)"
    ", k AS (SELECT id, split_part(array_to_string(list_filter(CASE WHEN stop > 0 THEN l[1:stop - 1] ELSE l END, lambda x: NOT starts_with(x, '>')), chr(10)), chr(10) || '-- ' || chr(10), 1) AS t FROM s)"
    ", e AS (SELECT id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+$', '')), chr(10)) AS t FROM k)"
)


@query(CLEAN + " SELECT id, md5(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS clean_md5 FROM e")
def cleaned_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every body, with a quote, a quoted original or a signature added by the message's id."""
    i = F.col("id")
    tail = F.when(i % 5 == 0, "\n-- \nme").when(i % 5 == 1, "\n -----Original Message-----  \nold").when(i % 5 == 2, "\n> quoted").otherwise("")
    said = F.concat(F.when(i % 4 == 0, "> said\n").otherwise(""), F.coalesce("body_text", F.lit("")), tail)
    rows = archive.with_bodies(archive.emails(spark, d).select("id"), spark, d).withColumn("body_text", said)
    return rows.select("id", F.md5(text.clean_body("body_text")).alias("clean_md5"))


@query("SELECT sha256, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.pdf' AS storage_path, reference_count FROM attachments")
def content_addressed(spark: SparkSession, d: str) -> DataFrame:
    lines = archive.attachment_lines(spark, d)
    mails = lines.groupBy(F.col("email_id").alias("message_id")).agg(F.collect_list(F.struct("filename", "content_type", "size", "sha256")).alias("attachments"))
    return mailbox.stored_attachments(mails)[0].select("sha256", "storage_path", "reference_count")


@query("WITH r AS (SELECT 'm' || (l_orderkey % 5000) AS message_id, l_orderkey, l_linenumber, l_partkey FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM r) SELECT message_id, l_orderkey, l_partkey FROM f WHERE k = 1 AND message_id NOT IN (SELECT 'm' || o_orderkey FROM orders WHERE o_orderkey < 100)", over="tables")
def loaded_once(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_orderkey") % 5000).alias("message_id"), "l_orderkey", "l_linenumber", "l_partkey", F.lit("a").alias("source_account"), F.lit("i").alias("import_id"))
    stored = archive.read(spark, d, "orders").filter("o_orderkey < 100").select(F.concat(F.lit("m"), "o_orderkey").alias("message_id"))
    return mailbox.load_once(stored, rows, "l_orderkey", "l_linenumber", "l_partkey")[0].select("message_id", "l_orderkey", "l_partkey")


@query("SELECT 'imp' || (o_orderkey % 4) AS import_id, count(*) AS messages_total, count(*) FILTER (o_orderkey % 3 = 0) AS messages_inserted, count(*) FILTER (o_orderkey % 3 <> 0) AS messages_skipped FROM orders GROUP BY 1", over="tables")
def import_totals(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d).select("id", "import_id")
    return mailbox.import_totals(m, m.filter("id % 3 = 0"))


@query("SELECT id AS email_id, 'acct2' AS source_account FROM emails WHERE id % 3 = 2 AND id % 2 = 0")
def reconciled_accounts(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    own = m.filter("not (id % 3 = 2 and id % 2 = 0)").select(F.col("id").alias("email_id"), "source_account", "import_id")
    lines = archive.attachment_lines(spark, d)
    _, missing = mailbox.reconcile(archive.attachments(lines), archive.bridge(lines), m, own)
    return missing.select("email_id", "source_account")


@query("SELECT id, CASE WHEN id % 3 = 1 THEN 'late' ELSE source_account END AS source_account FROM emails")
def backfilled_accounts(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    untagged = m.withColumn("source_account", F.when(F.col("id") % 3 != 1, F.col("source_account")))
    return mailbox.backfill_account(untagged, archive.email_accounts(m).filter("email_id < 0"), "late")[0].select("id", "source_account")


@query("SELECT 'mig' AS id, 'late' AS source_account, 'migration' AS source_file, 'completed' AS status, count(*) FILTER (id % 3 = 1) AS messages_total, count(*) FILTER (id % 3 = 1) AS messages_inserted, count(*) FILTER (id % 3 = 1) AS attributed, 0 AS again FROM emails")
def migration_imports(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's row of a backfill, how many attribution rows carry it, and how many messages a second one would tag."""
    m = archive.emails(spark, d)
    untagged = m.withColumn("source_account", F.when(F.col("id") % 3 != 1, F.col("source_account")))
    tagged, accounts = mailbox.backfill_account(untagged, archive.email_accounts(m).filter("email_id < 0"), "late", "mig")
    carried = accounts.agg(F.count_if(F.col("import_id") == "mig").alias("attributed"))
    again = mailbox.migration_import(tagged, "late", "mig2").select(F.col("messages_total").alias("again"))
    return mailbox.migration_import(untagged, "late", "mig").crossJoin(carried).crossJoin(again)  # of one row each


@query("SELECT '- **' || c_name || '** — c_mktsegment: ' || c_mktsegment || '; c_nationkey: ' || c_nationkey AS value FROM customer", over="tables")
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_lines(archive.read(spark, d, "customer"), "c_name", "c_mktsegment", "c_nationkey")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2", over="tables")
def stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The stream job's windows over the same rows read as a batch."""
    from lettermill.streaming.jobs import bucket_counts

    rows = archive.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return bucket_counts(rows, key="event_type").select(ts("window.start").alias("bucket"), "event_type", "n")


@query(
    """WITH days AS (SELECT *, date_diff('day', min(ts::DATE) OVER (), ts::DATE) AS day FROM events),
arrived AS (SELECT ts, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, least(5, day // 5 + CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END) AS part FROM days),
parts AS (SELECT part, max(ts) AS newest FROM arrived GROUP BY 1),
marks AS (SELECT p.part, max(q.newest) - INTERVAL 10 MINUTE AS watermark FROM parts p LEFT JOIN parts q ON q.part < p.part GROUP BY 1),
tagged AS (SELECT bucket, coalesce(bucket + INTERVAL 1 HOUR <= watermark, false) AS late FROM arrived JOIN marks USING (part))
SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM tagged GROUP BY 1""",
    over="tables",
)
def stream_late_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of six arrivals, of which every fortieth comes two arrivals late: what was counted, and what came too late."""
    from lettermill.streaming import jobs, stores

    rows = archive.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = rows.agg(F.min(F.to_date("ts")).alias("d")).first()["d"]
    part = F.least(F.lit(5), F.floor(F.date_diff("ts", F.lit(first)) / 5) + F.when(F.col("event_id") % 40 == 0, 2).otherwise(0))
    path = fresh_path(spark, "late_buckets")
    for k in range(6):
        rows.filter(part == k).write.mode("append").parquet(f"{path}/in")
        jobs.each_batch(jobs.read_files(spark, f"{path}/in", rows.schema), stores.count_buckets(path), f"{path}/checkpoint").awaitTermination()
    counted = stores.counted_buckets(spark, path).select("start", "n", F.lit(0).alias("late"))
    late = stores.late_rows(spark, path).select((F.col("window_end") - F.expr("INTERVAL 1 HOUR")).alias("start"), F.lit(0).alias("n"), F.lit(1).alias("late"))
    return counted.unionAll(late).groupBy(ts("start").alias("bucket")).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


@query(DAYS + ", spikes AS (SELECT * FROM days WHERE cnt >= 70), isl AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY day) AS g FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY series ORDER BY day) <= 3 THEN 0 ELSE 1 END AS new FROM spikes)) SELECT series, strftime(min(day), '%Y-%m-%d') AS first_spike, strftime(max(day), '%Y-%m-%d') AS last_spike, sum(cnt)::BIGINT AS spike_total FROM isl GROUP BY series, g", over="tables")
def stream_spikes(spark: SparkSession, d: str) -> DataFrame:
    from lettermill.streaming.jobs import spike_sessions

    spikes = _days(spark, d).filter("cnt >= 70").withColumn("day", F.col("day").cast("timestamp"))
    return spike_sessions(spikes).select("series", F.date_format("first_spike", "yyyy-MM-dd").alias("first_spike"), F.date_format("last_spike", "yyyy-MM-dd").alias("last_spike"), "spike_total")
