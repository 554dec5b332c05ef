"""Threads, identities, contact profiles, extracted events, manifests, overlays and import records over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.operators import cards, contacts, events, files, health, messages, threads, timeline, topics
from lettermill.operators.predicates import keyset_after
from lettermill.plans.registry import TS, joined, query, ts
from lettermill.sources import archive, mailbox, mbox, sinks
from lettermill.staging import fresh_path


@query(f"SELECT id, {TS.format('date')} AS date FROM emails WHERE thread_id = 't42'")
def thread_of_id(spark: SparkSession, d: str) -> DataFrame:
    return messages.thread(archive.emails(spark, d), "t42").select("id", ts("date").alias("date"))


@query("SELECT id, thread_id FROM emails WHERE thread_id = (SELECT thread_id FROM emails WHERE message_id = 'm4007')")
def thread_of_message(spark: SparkSession, d: str) -> DataFrame:
    return messages.thread_of(archive.emails(spark, d), "m4007").select("id", "thread_id")


CONFIGURED = ["u7@d2.example", "acct2", "u14@d4.example", "u7@d2.example"]


@query("SELECT address, row_number() OVER (ORDER BY k, address) - 1 AS pos FROM (SELECT address, min(k) AS k FROM (SELECT unnest(['u7@d2.example', 'acct2', 'u14@d4.example']) AS address, unnest([0, 1, 2]) AS k UNION ALL SELECT DISTINCT source_account, 9 FROM emails) GROUP BY 1)")
def own_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.identities(archive.emails(spark, d).select("source_account"), CONFIGURED)
    return rows.select("address", F.col("pos").cast("long").alias("pos"))


PROFILE = """, sent AS (SELECT sender_address AS address, count(*) AS n FROM emails GROUP BY 1),
got AS (SELECT recipient_address AS address, count(DISTINCT id) AS n FROM sent_to WHERE sender_address IN (SELECT address FROM me) GROUP BY 1),
w AS (SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || (c_custkey // 2) AS contact_id, c_custkey % 7 = 0 AS mine FROM customer),
book AS (SELECT w.*, coalesce(s.n, 0) AS f, coalesce(g.n, 0) AS t FROM w LEFT JOIN sent s USING (address) LEFT JOIN got g USING (address) WHERE s.n IS NOT NULL OR g.n IS NOT NULL),
th AS (SELECT contact_id, count(DISTINCT thread_id) AS n FROM emails JOIN w ON w.address = sender_address GROUP BY 1)
"""


def _contact_book(spark: SparkSession, d: str) -> DataFrame:
    who = archive.read(spark, d, "customer").select(archive.addr(F.col("c_custkey")).alias("address"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)).alias("contact_id"))
    book = contacts.address_book(archive.emails(spark, d), archive.identities(spark, d), existing=who)
    return book.join(who.select("address"), "address", "left_semi")


@query(PROFILE + "SELECT contact_id, CASE WHEN bool_and(mine) THEN 'owner' ELSE 'external' END AS class, string_agg(address || ':' || f || ':' || t, '|' ORDER BY f + t DESC, address) AS addresses, coalesce(max(th.n), 0) AS threads, CASE WHEN split_part(contact_id, 'c', 2)::BIGINT % 5 = 0 THEN 'm' || contact_id ELSE '' END AS merged FROM book LEFT JOIN th USING (contact_id) GROUP BY contact_id")
def contact_profiles(spark: SparkSession, d: str) -> DataFrame:
    book = _contact_book(spark, d)
    merges = archive.read(spark, d, "customer").filter("floor(c_custkey / 2) % 5 = 0").select(F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)).alias("target_id")).distinct()
    merges = merges.select(F.concat(F.lit("m"), "target_id").alias("source_id"), "target_id", F.lit("2025-01-01").cast("timestamp").alias("merged_at"))
    rows = contacts.profiles(book, archive.emails(spark, d), merges)
    addresses = F.transform("addresses", lambda a: F.concat_ws(":", a["address"], a["messages_from"], a["messages_to"]))
    return rows.select("contact_id", "class", joined(addresses).alias("addresses"), "threads", joined(F.transform("merged", lambda m: m["source_id"])).alias("merged"))


@query("SELECT contact_id, count(DISTINCT thread_id) AS threads FROM emails JOIN (SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || (c_custkey // 2) AS contact_id FROM customer) w ON w.address = sender_address GROUP BY 1")
def contact_threads(spark: SparkSession, d: str) -> DataFrame:
    return contacts.thread_counts(_contact_book(spark, d), archive.emails(spark, d))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'named ' || c_custkey END, c_name) AS name, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 = 0 THEN 'human' ELSE 'unknown' END AS kind FROM customer", over="tables")
def curated_contacts(spark: SparkSession, d: str) -> DataFrame:
    c = archive.read(spark, d, "customer")
    computed = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("unknown").alias("kind"))
    overlay = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("named "), "c_custkey").alias("name"), F.when(F.col("c_custkey") % 8 == 0, "human").alias("kind"))
    return contacts.curated(computed, overlay)


@query("WITH known AS (SELECT c_custkey AS k, lower(c_name) AS n FROM customer), asked AS (SELECT DISTINCT 'Customer#' || substr(c_name, 10, 7) AS name FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'X' || c_custkey || '@Y.example' FROM customer WHERE c_custkey % 50 = 0), hits AS (SELECT name, min(k) AS k, count(*) AS n FROM asked JOIN known ON contains(known.n, lower(name)) WHERE NOT contains(name, '@') GROUP BY 1) SELECT name, 'u' || k || '@d' || (k % 5) || '.example' AS address FROM hits WHERE n = 1 UNION ALL SELECT name, lower(name) FROM asked WHERE contains(name, '@')", over="tables")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    c = archive.read(spark, d, "customer")
    people = c.select(F.concat(F.lit("c"), "c_custkey").alias("contact_id"), archive.addr(F.col("c_custkey")).alias("primary_address"), F.array(archive.addr(F.col("c_custkey"))).alias("addresses"), F.col("c_name").alias("display_name"), F.array("c_name").alias("name_variants"))
    asked = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("Customer#"), F.substring("c_name", 10, 7)).alias("name")).unionByName(c.filter("c_custkey % 50 = 0").select(F.concat(F.lit("X"), "c_custkey", F.lit("@Y.example")).alias("name"))).distinct()
    return contacts.resolve_substrings(asked, people)


def _outputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Model outputs made from the orders: one event each, some with a bad type, a late date or an unknown marker."""
    o = archive.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    kind = F.when(F.col("k") % 6 == 0, "party").otherwise("travel")
    content = F.to_json(F.array(F.struct(F.concat(F.lit(" Trip "), "k", F.lit(" ")).alias("title"), kind.alias("event_type"), F.date_format(F.date_add("day", (F.col("k") % 9).cast("int")), "yyyy-MM-dd").alias("date"), F.array(F.struct(F.lit("said").alias("text"), F.array(F.lit("S0"), F.concat(F.lit("S"), F.col("k") % 4)).alias("source_markers"))).alias("claims"))))
    outputs = o.select(F.col("k").alias("output_id"), content.alias("content"), F.col("day").alias("window_start"), F.date_add("day", 5).alias("window_end"))
    sources = o.select(F.col("k").alias("output_id"), F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("marker")).withColumn("source_id", F.concat(F.lit("msg_"), "output_id", "marker"))
    return outputs, sources


@query("SELECT o_orderkey AS output_id, 'Trip ' || o_orderkey AS title, strftime(o_orderdate::DATE + least(o_orderkey % 9, 5)::INT, '%Y-%m-%d') AS date, 'medium' AS evidence_strength, 'msg_' || o_orderkey || 'S' || (o_orderkey % 4) AS citations FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 4 IN (1, 2)", over="tables")
def extracted_events(spark: SparkSession, d: str) -> DataFrame:
    rows = events.parse_extracted(*_outputs(spark, d))
    return rows.select("output_id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "evidence_strength", joined(F.flatten(F.transform("claims", lambda c: c["citations"]))).alias("citations"))


def _stored_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, versions, extracted): for every order an event of its day; later extractions of the same, another or no event."""
    o = archive.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"))
    ident = F.concat(F.lit("e"), F.col("k"))
    rows = o.select(ident.alias("id"), F.concat(F.lit("Trip "), "k").alias("title"), F.col("at").alias("time_start"), F.lit(None).cast("timestamp").alias("time_end"), F.when(F.col("k") % 7 == 0, "manual").otherwise("automatic").alias("origin"), F.when(F.col("k") % 2 == 0, "unreviewed").otherwise("confirmed").alias("status"), F.lit("s").alias("scope_fingerprint"), F.lit(1).alias("current_version"))
    versions = o.select(ident.alias("event_id"), F.lit(1).alias("version"), F.lit("automatic").alias("author"), F.concat(F.lit("Trip "), "k").alias("title"), F.lit(None).cast("string").alias("summary"))
    day = F.col("at").cast("date")
    shift = F.when(F.col("k") % 5 == 0, 30).otherwise(0)
    new = o.filter("k % 3 = 0").select(F.concat(F.lit("n"), "k").alias("new_id"), F.lit("s").alias("scope_fingerprint"), F.concat(F.lit(" TRIP  "), "k").alias("title"), day.alias("date"), F.date_add(F.date_sub(day, 1), shift).alias("burst_start"), F.date_add(F.date_add(day, 1), shift).alias("burst_end"), F.lit("travel").alias("event_type"), F.lit("low").alias("evidence_strength"), F.lit(None).cast("string").alias("summary"))
    return rows, versions, new


OUTCOME = "CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'created' WHEN o_orderkey % 2 = 0 THEN 'superseded' ELSE 'suggested' END"


@query(f"SELECT 'n' || o_orderkey AS new_id, CASE WHEN {OUTCOME} = 'created' THEN 'n' ELSE 'e' END || o_orderkey AS event_id, CASE WHEN {OUTCOME} = 'created' THEN 1 ELSE 2 END AS version, {OUTCOME} AS outcome FROM orders WHERE o_orderkey % 3 = 0", over="tables")
def upserted_events(spark: SparkSession, d: str) -> DataFrame:
    return events.upsert(*_stored_events(spark, d))[2]


@query(f"WITH o AS (SELECT o_orderkey AS k, {OUTCOME} AS outcome FROM orders) SELECT 'e' || k AS id, CASE WHEN k % 3 = 0 AND outcome = 'superseded' THEN 2 ELSE 1 END AS current_version, CASE WHEN k % 3 = 0 AND outcome = 'superseded' THEN ' TRIP  ' || k ELSE 'Trip ' || k END AS title, k % 3 = 0 AND outcome = 'suggested' AS has_suggestions, (k % 10 = 0 AND NOT (k % 3 = 0 AND outcome = 'superseded'))::INT AS claims FROM o UNION ALL SELECT 'n' || k, 1, ' TRIP  ' || k, false, 0 FROM o WHERE k % 3 = 0 AND outcome = 'created'", over="tables")
def current_events(spark: SparkSession, d: str) -> DataFrame:
    stored, versions, _ = events.upsert(*_stored_events(spark, d))
    claims = archive.read(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("e"), "o_orderkey").alias("event_id"), F.lit(1).alias("version"), F.lit(0).alias("position"), F.lit("said").alias("text"), F.lit("direct").alias("status"))
    rows = events.full_events(stored, versions, claims)
    return rows.select("id", "current_version", F.col("version_title").alias("title"), "has_suggestions", F.coalesce(F.size("claims"), F.lit(0)).alias("claims"))


CLAIMS = "WITH c AS (SELECT l_orderkey AS e, l_linenumber::INT AS p, CASE l_partkey % 5 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'supported' ELSE 'direct' END AS s, l_suppkey % 3 AS src FROM lineitem)"


@query(CLAIMS + ", torn AS (SELECT e, src FROM c GROUP BY 1, 2 HAVING bool_or(s = 'direct') AND bool_or(s = 'conflicting')) SELECT DISTINCT c.e AS event_id, c.p AS position FROM c LEFT JOIN torn t ON t.e = c.e AND t.src = c.src WHERE t.e IS NOT NULL OR s = 'conflicting'", over="tables")
def conflicting_claims(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_partkey") % 5
    status = F.when(n == 0, "conflicting").when(n == 1, "supported").otherwise("direct")
    rows = archive.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("int").alias("position"), status.alias("status"), F.array(F.struct(F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("source_id"))).alias("citations"))
    return events.claim_conflicts(rows)


MANIFEST = "WITH used AS (SELECT 'msg_' || (conv_id % 300) AS source_id, 0 AS kind, (conv_id * 100 + turn)::BIGINT AS position, CASE WHEN turn % 3 = 1 THEN 'h' || conv_id || '-' || turn END AS h FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT 'msg_' || (conv_id % 400), 1, conv_id * 100 + turn, 'h' || conv_id || '-' || turn FROM conversations WHERE turn % 2 = 1)"


@query(MANIFEST + " SELECT source_id, o_orderpriority AS title, first(h ORDER BY kind, position) FILTER (h IS NOT NULL) AS excerpt_hash FROM used LEFT JOIN orders ON 'msg_' || o_orderkey = source_id GROUP BY 1, 2", over="tables")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = archive.read(spark, d, "conversations")
    position = (F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("position")
    mark = F.concat(F.lit("h"), "conv_id", F.lit("-"), "turn")
    pins = c.filter("turn % 2 = 0").select(F.concat(F.lit("msg_"), F.col("conv_id") % 300).alias("source_id"), position, F.when(F.col("turn") % 3 == 1, mark).alias("excerpt_hash"))
    cited = c.filter("turn % 2 = 1").select(F.concat(F.lit("msg_"), F.col("conv_id") % 400).alias("source_id"), position, mark.alias("excerpt_hash"))
    known = archive.read(spark, d, "orders").select(F.concat(F.lit("msg_"), "o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("title"))
    return events.manifest(pins, cited, known).select("source_id", "title", "excerpt_hash")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'x' || id ELSE thread_id END AS thread_id FROM emails")
def rewritten_threads(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    changes = m.filter("id % 6 = 0").select("id", F.concat(F.lit("x"), "id").alias("new_thread_id"))
    return threads.apply_repair(m, changes).select("id", "thread_id")


@query("SELECT topic_id, count(*) AS members, count(*) FILTER (origin = 'manual') AS manual FROM (SELECT CASE WHEN id % 10 = 3 THEN 't0' ELSE 't' || (id % 12) END AS topic_id, CASE WHEN id % 10 = 3 THEN 'manual' ELSE 'automatic' END AS origin FROM emails WHERE id % 10 = 3 OR NOT (id % 12 = 5 AND id % 4 = 1) UNION ALL SELECT 't' || (id % 12), 'automatic' FROM emails WHERE id % 10 = 3 AND id % 12 <> 0 AND NOT (id % 12 = 5 AND id % 4 = 1)) GROUP BY 1")
def curated_members(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d).select("id")
    topic = F.concat(F.lit("t"), F.col("id") % 12)
    members = m.select(topic.alias("topic_id"), F.col("id").alias("email_id"), F.lit("automatic").alias("origin"))
    includes = m.filter("id % 10 = 3").select(F.lit("t0").alias("topic_id"), F.col("id").alias("email_id"))
    excludes = m.filter("id % 12 = 5 and id % 4 = 1").select(topic.alias("topic_id"), F.col("id").alias("email_id"))
    rows = topics.with_overlay(members, includes, excludes)
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("origin") == "manual").alias("manual"))


@query(f"SELECT id, {TS.format('date')} AS date FROM emails WHERE id % 12 = 7 AND (date < TIMESTAMP '1996-06-01' OR (date = TIMESTAMP '1996-06-01' AND id < 5000) OR date IS NULL) ORDER BY emails.date DESC NULLS LAST, id DESC LIMIT 51")
def topic_member_page(spark: SparkSession, d: str) -> DataFrame:
    members = archive.emails(spark, d).filter("id % 12 = 7")
    rows = members.filter(keyset_after("1996-06-01", 5000, descending=True)).orderBy(F.col("date").desc_nulls_last(), F.desc("id")).limit(51)
    return rows.select("id", ts("date").alias("date"))


@query("SELECT doc_id, len(l)::INT AS n, array_to_string(l, '|') AS labels FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)", over="tables")
def label_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "documents").select("doc_id", text.label_list("text").alias("l"))
    return rows.select("doc_id", F.size("l").alias("n"), joined("l").alias("labels"))


@query("SELECT p_partkey AS id, strftime(CASE p_size % 4 WHEN 0 THEN TIMESTAMP '2024-01-05' + (p_partkey % 24) * INTERVAL 1 HOUR WHEN 1 THEN TIMESTAMP '2024-01-05' WHEN 2 THEN TIMESTAMP '2024-01-05 10:30:00' END, '%Y-%m-%d %H:%M:%S') AS at FROM part", over="tables")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 4
    said = F.when(n == 0, F.concat(F.lit("2024-01-05T"), F.lpad((F.col("p_partkey") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))).when(n == 1, " 2024-01-05 ").when(n == 2, "2024-01-05T12:30:00+02:00").otherwise("soon")
    return archive.read(spark, d, "part").select(F.col("p_partkey").alias("id"), ts(text.lenient_timestamp(said)).alias("at"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[$€£]?\\s?\\d[\\d,.]*'))::INT AS n, list_min(regexp_extract_all(text, '[$€£]?\\s?\\d[\\d,.]*')) AS least FROM documents WHERE text IS NOT NULL", over="tables")
def text_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "documents").filter("text is not null").select("doc_id", files.amounts("text").alias("a"))
    return rows.select("doc_id", F.size("a").alias("n"), F.array_min("a").alias("least"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower('  ' || p_name || '   ' || p_brand || ' '), '\\s+', ' ', 'g')) AS title FROM part", over="tables")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))
    return archive.read(spark, d, "part").select(F.col("p_partkey").alias("id"), events.title_key(said).alias("title"))


@query("SELECT 'orders' AS name, count(*) || '-' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS version FROM orders UNION ALL SELECT 'events', count(*) || '-' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events", over="tables")
def data_versions(spark: SparkSession, d: str) -> DataFrame:
    orders = archive.read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    rows = archive.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
    return health.data_versions({"orders": orders, "events": rows})


@query("SELECT event_id AS id, strftime(CASE WHEN event_type = 'error' THEN ts ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events", over="tables")
def mark_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.read(spark, d, "events").select(F.col("event_id").alias("id"), events.mark_position(F.col("ts").cast("timestamp"), F.when(F.col("event_type") == "error", "hour").otherwise("week")).alias("at"))
    return rows.select("id", ts("at").alias("at"))


@query("SELECT CASE WHEN n % 10 < 6 THEN 'extracted' ELSE 'skipped' END AS status, count(*) AS n FROM (SELECT doc_id AS n, text FROM documents) GROUP BY 1", over="tables")
def extraction_outcomes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 10
    rows = archive.read(spark, d, "documents").select(health.outcome(F.lit(None).cast("string"), health.route(F.when(n < 6, "text/plain").when(n < 8, "image/png").otherwise("font/ttf")), F.concat(F.lit("t"), F.coalesce("text", F.lit(""))), F.lit(100)).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT import_id AS id, 'running' AS before, CASE import_id WHEN 'imp3' THEN 'failed' ELSE 'completed' END AS status, messages_total, messages_inserted, messages_skipped FROM (SELECT 'imp' || (o_orderkey % 4) AS import_id, count(*) AS messages_total, count(*) FILTER (o_orderkey % 3 = 0) AS messages_inserted, count(*) FILTER (o_orderkey % 3 <> 0) AS messages_skipped FROM orders GROUP BY 1) UNION ALL SELECT 'imp9', 'running', 'completed', 0, 0, 0", over="tables")
def closed_imports(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d).select("id", "import_id")
    ledger = spark.createDataFrame([(f"imp{i}", "acct", f"f{i}", "running") for i in (0, 1, 2, 3, 9)], "id string, source_account string, source_file string, status string")
    failed = spark.createDataFrame([("imp3",)], "id string")
    rows = mailbox.close_imports(ledger, mailbox.import_totals(m, m.filter("id % 3 = 0")), failed)
    return rows.select("id", F.lit("running").alias("before"), "status", "messages_total", "messages_inserted", "messages_skipped")


@query("SELECT sha256 FROM (SELECT sha256 FROM attachments WHERE sha256 NOT IN (SELECT sha256 FROM contents)) ORDER BY sha256 LIMIT 5")
def first_pending(spark: SparkSession, d: str) -> DataFrame:
    atts = archive.attachments(archive.attachment_lines(spark, d))
    return health.chosen_pending(health.pending(atts, archive.contents(atts)), limit=5).select("sha256")


@query("SELECT count(*) FILTER (p < 0.3) AS low, count(*) FILTER (p >= 0.3 AND p <= 0.7) AS middle, count(*) FILTER (p > 0.7) AS high FROM (SELECT (c_custkey % 100) / 100.0::DOUBLE AS p FROM customer)", over="tables")
def probability_bands(spark: SparkSession, d: str) -> DataFrame:
    return contacts.probability_bands(archive.read(spark, d, "customer").select((F.col("c_custkey") % 100 / F.lit(100.0)).alias("human_probability")))


@query(
    r"""WITH RECURSIVE whole AS (SELECT doc_id, 'Subject: ' || coalesce(source, '') || chr(10) || 'From: ' || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') AS t FROM documents),
found(doc_id, low, high) AS (SELECT doc_id, 0, length(t) FROM whole UNION ALL
  SELECT doc_id, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid - 1 END FROM (SELECT doc_id, low, high, mid, strlen(s) // 4 + coalesce(list_sum(list_transform(regexp_extract_all(s, 'https?://\S+'), lambda u: strlen(u))), 0)::BIGINT // 2 <= 7500 AS fits
    FROM (SELECT f.*, (low + high + 1) // 2 AS mid, left(t, (low + high + 1) // 2) AS s FROM found f JOIN whole w ON w.doc_id = f.doc_id WHERE low < high)))
SELECT w.doc_id, length(left(t, low))::INT AS chars, md5(left(t, low)) AS text_md5 FROM found f JOIN whole w ON w.doc_id = f.doc_id WHERE low = high""".replace("\\\\", "\\"),
    over="tables",
)
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text, those that are cut too."""
    rows = archive.read(spark, d, "documents").select("doc_id", text.embedding_text("source", "lang", "text").alias("t"))
    return rows.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


@query(", e AS (SELECT id, CASE WHEN id % 3 <> 0 AND trim(coalesce(body_text, ''), ' ') <> '' THEN body_text ELSE trim(regexp_replace(coalesce('<div><p class=x>' || body_text || '</p><br/></div>', ''), '<[^>]+>', ' ', 'g'), ' ') END AS t FROM bodies) SELECT id, length(substr(t, 1, 2000))::INT AS chars, sha256(substr(t, 1, 300)) AS sha256 FROM e")
def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    """A third of the messages have markup only."""
    rows = archive.with_bodies(archive.emails(spark, d).select("id"), spark, d).withColumn("body_html", F.concat(F.lit("<div><p class=x>"), "body_text", F.lit("</p><br/></div>")))
    rows = rows.withColumn("body_text", F.when(F.col("id") % 3 != 0, F.col("body_text")))
    return rows.select("id", text.evidence_text("body_text", "body_html").alias("e")).select("id", F.length("e.text").alias("chars"), "e.sha256")


@query("SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS done, count(*) / 30 AS rate FROM (SELECT date_trunc('minute', ts) - to_minutes(unnest(range(30))::INT) AS start FROM events) GROUP BY 1", over="tables")
def stream_throughput(spark: SparkSession, d: str) -> DataFrame:
    """The stream job's sliding windows over the same rows read as a batch."""
    from lettermill.streaming.jobs import throughput

    rows = archive.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return throughput(rows).select(ts("window.start").alias("start"), "done", "rate")


@query(", n AS (SELECT sender_address, count(*) FILTER (year(date) = 1996) AS old, count(*) FILTER (year(date) = 1997) AS new FROM emails GROUP BY 1) SELECT sender_address, old, new, CASE WHEN old = 0 AND new = 0 THEN 0 WHEN old = 0 THEN NULL ELSE round((new - old) / old * 100, 6) END AS change FROM n")
def yearly_changes(spark: SparkSession, d: str) -> DataFrame:
    year = lambda y: F.count_if(F.year("date") == y)
    rows = archive.emails(spark, d).groupBy("sender_address").agg(year(1996).alias("old"), year(1997).alias("new"))
    return rows.withColumn("change", F.round(timeline.percent_change(F.col("old"), F.col("new")), 6))


@query("SELECT substr(sha256, 1, 2) AS prefix, sha256, filename AS text FROM contents WHERE status = 'extracted'")
def mirrored_texts(spark: SparkSession, d: str) -> DataFrame:
    """The mirror of extracted texts, read back from its partitions; the file name stands for the text."""
    path = fresh_path(spark, "mirror")
    sinks.write_mirror(archive.contents(archive.attachments(archive.attachment_lines(spark, d))), path, text="filename")
    return spark.read.parquet(path).select(F.col("prefix").cast("string").alias("prefix"), "sha256", F.col("filename").alias("text"))


@query(f"SELECT id, subject FROM emails WHERE sender_domain = 'd1.example' ORDER BY sender_address, id LIMIT 70")
def spec_hidden_order(spark: SparkSession, d: str) -> DataFrame:
    from lettermill.operators import spec

    asked = {"where": {"field": "sender_domain", "eq": "d1.example"}, "select": ["id", "subject"], "order_by": ["sender_address", "id"], "limit": 70}
    return spec.query(archive.emails(spark, d), asked)


@query("SELECT (SELECT count(*) FROM emails) AS messages, (SELECT count(DISTINCT thread_id) FROM emails) AS threads, (SELECT count(*) FROM emails WHERE date IS NULL) AS undated, (SELECT max(n) FROM (SELECT count(*) AS n FROM emails GROUP BY thread_id)) AS largest, (SELECT count(*) FROM contents WHERE status = 'extracted') AS extracted, (SELECT count(*) FROM contents WHERE status = 'failed') AS failed, (SELECT count(*) FROM vectors WHERE v IS NULL) AS missing_vectors, round((SELECT count(*) FROM emails WHERE id % 12 < 8) / (SELECT count(*) FROM emails), 9)::DOUBLE AS topic_ratio, (SELECT count(DISTINCT import_id) FROM emails) AS imports")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    m = archive.with_vectors(archive.emails(spark, d), spark, d)
    members = m.filter("id % 12 < 8").select(F.col("id").alias("email_id"))
    contents = archive.contents(archive.attachments(archive.attachment_lines(spark, d)))
    return health.report(m, contents, members).withColumn("topic_ratio", F.round("topic_ratio", 9))


@query(", n AS (SELECT sha256, count(*) AS n FROM bridge GROUP BY 1) SELECT a.sha256, coalesce(c.status, 'pending') AS status, n.n AS duplicates FROM attachments a JOIN n USING (sha256) LEFT JOIN contents c USING (sha256) WHERE a.content_type = 'application/pdf' ORDER BY n.n DESC, a.sha256 LIMIT 20")
def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    lines = archive.attachment_lines(spark, d)
    atts = archive.attachments(lines)
    counts = archive.bridge(lines).groupBy("sha256").agg(F.count(F.lit(1)).alias("duplicates"))
    rows = cards.with_status(atts.filter(cards.attachment_filter(content_types=["application/pdf"])), archive.contents(atts)).join(counts, "sha256")
    return rows.orderBy(F.desc("duplicates"), "sha256").limit(20).select("sha256", "status", "duplicates")


def _raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """The archive's messages as text; every fiftieth has lost its Message-ID, every seventy-seventh cannot be read at all."""
    m = archive.emails(spark, d).select("id", "message_id", "sender_address", "sender_name", "subject", "import_id")
    ident = F.when(F.col("id") % 50 != 0, F.concat(F.lit("Message-ID: <"), "message_id", F.lit(">\n"))).otherwise("")
    said = F.concat(F.lit("From x\n"), ident, F.lit("From: "), F.coalesce("sender_name", F.lit("")), F.lit(" <"), "sender_address", F.lit(">\nSubject: "), "subject", F.lit("\n\nFrom the body of "), F.col("id").cast("string"), F.lit("\n"))
    return m.select(F.when(F.col("id") % 77 != 0, said).alias("said"), "import_id")


@query("SELECT import_id, count(*) AS messages, count(*) FILTER (id % 77 = 0 OR id % 50 = 0) AS errors, count(*) FILTER (id % 77 <> 0 AND id % 50 = 0) AS no_id FROM emails GROUP BY 1")
def quarantined_messages(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_messages(spark, d).select(F.col("said").cast("binary").alias("raw"), "import_id")
    return mailbox.store_parsed(raw, fresh_path(spark, "parsed"))


@query("SELECT message_id, sender_address, subject FROM emails WHERE id % 77 <> 0 AND id % 50 <> 0")
def mbox_messages(spark: SparkSession, d: str) -> DataFrame:
    """The same messages written to mailbox files and read back in ranges of 20,000 bytes."""
    path = fresh_path(spark, "mbox")
    _raw_messages(spark, d).filter("said is not null").select(F.rtrim("said").alias("said")).write.text(path)
    mbox.register(spark)
    rows = spark.read.format("mbox").option("split_bytes", 20_000).load(path)
    return mailbox.parse_messages(rows.select("raw")).select("message_id", "sender_address", "subject")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 3 = 1 THEN 'pdf' ELSE 'csv' END AS bucket, CASE WHEN doc_id % 3 <> 1 THEN md5(coalesce(text, '')) END AS text_md5 FROM documents", over="tables")
def passthrough_texts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("doc_id") % 3 == 0, "text/plain").when(F.col("doc_id") % 3 == 1, "application/pdf").otherwise("TEXT/CSV")
    files = archive.read(spark, d, "documents").select("doc_id", health.route(kinds).alias("bucket"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files.select("doc_id", "bucket", F.md5(health.passthrough_text(F.col("content"), F.col("bucket"))).alias("text_md5"))
