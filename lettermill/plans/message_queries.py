"""Message lists, unanswered messages, correspondents, specs and timeline lanes over the archive views."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.vectors import norm
from lettermill.operators import keywords, messages, pages, spec, timeline
from lettermill.operators.predicates import content_family, keyset_after, mentions, message_filter, of_account, order_by, scope_filter
from lettermill.plans.registry import ORACLES, TS, joined, query, ts
from lettermill.sources import archive
from lettermill.staging import fresh_path, staged

RANGE = ("1995-01-01", "1999-01-01")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return archive.emails(spark, d)


@query(f"SELECT id, message_id, sender_address, {TS.format('date')} AS date, array_to_string(to_l, '|') AS to_list FROM emails WHERE date >= '1995-01-01' AND date < '1999-01-01' AND sender_domain = 'd3.example' AND has_attachment")
def find_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.find(_mails(spark, d), limit=None, sender_domain="d3.example", after=RANGE[0], before=RANGE[1], has_attachment=True)
    return rows.select("id", "message_id", "sender_address", ts("date").alias("date"), joined("recipients.to").alias("to_list"))


@query("SELECT id, sender_address FROM emails WHERE list_contains(to_l, 'u7@d2.example') OR list_contains(cc_l, 'u7@d2.example') OR list_contains(bcc_l, 'u7@d2.example')")
def find_recipient(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=None, recipient="u7@d2.example").select("id", "sender_address")


@query("SELECT id FROM emails WHERE sender_address = 'u11@d1.example'")
def find_sender(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=None, sender="u11@d1.example").select("id")


@query("SELECT id, len(to_l)::BIGINT AS n_to, len(cc_l)::BIGINT AS n_cc FROM emails WHERE len(to_l) <= 2 AND len(cc_l) <= 1 AND len(to_l) + len(cc_l) + len(bcc_l) <= 3")
def find_recipient_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.find(_mails(spark, d), limit=None, max_to=2, max_cc=1, max_recipients=3)
    return rows.select("id", F.size("recipients.to").cast("long").alias("n_to"), F.size("recipients.cc").cast("long").alias("n_cc"))


@query("SELECT id FROM emails WHERE len(to_l) <= 1 AND len(cc_l) <= 0")
def find_direct_only(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=None, direct_only=True).select("id")


@query("SELECT id FROM emails WHERE list_has_all(labels, ['1-URGENT', 'F'])")
def find_labels(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=None, labels=["1-URGENT", "F"]).select("id")


@query("SELECT id, subject FROM emails WHERE contains(lower(subject), 're: 2')")
def find_subject(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=None, subject_contains="RE: 2").select("id", "subject")


@query("SELECT id FROM emails WHERE id IN (SELECT email_id FROM email_accounts WHERE source_account = 'acct1')")
def find_account(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    return of_account(m, archive.email_accounts(m), "acct1").select("id")


@query(f"SELECT id, {TS.format('date')} AS date FROM emails ORDER BY emails.date DESC NULLS LAST, id LIMIT 40 OFFSET 10")
def list_newest(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), limit=40, offset=10).select("id", ts("date").alias("date"))


@query(f"SELECT id, {TS.format('date')} AS date FROM emails ORDER BY emails.date ASC NULLS FIRST, id LIMIT 200")
def list_oldest(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), order="date ASC", limit=200).select("id", ts("date").alias("date"))


@query("SELECT id, sender_address FROM emails ORDER BY sender_address DESC NULLS FIRST, id LIMIT 60")
def list_by_sender(spark: SparkSession, d: str) -> DataFrame:
    return messages.find(_mails(spark, d), order="sender_address DESC", limit=60).select("id", "sender_address")


@query("SELECT count(*) AS total FROM emails WHERE sender_domain = 'd1.example'")
def find_total(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d).filter(message_filter(sender_domain="d1.example")).agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT id, {TS.format('date')} AS date FROM emails WHERE date > TIMESTAMP '1998-06-01' OR (date = TIMESTAMP '1998-06-01' AND id > 500) OR date IS NULL ORDER BY emails.date ASC NULLS LAST, id LIMIT 101")
def page_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    rows = _mails(spark, d).filter(keyset_after("1998-06-01", 500))
    return rows.orderBy(F.col("date").asc_nulls_last(), "id").limit(101).select("id", ts("date").alias("date"))


@query(ORACLES["page_after_cursor"].removeprefix(archive.SQL).replace("LIMIT 101", "LIMIT 150"))
def laid_out_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of fifty from a table that is laid out in their order, each after the last row of the one before."""
    path = fresh_path(spark, "pages")
    pages.lay_out(_mails(spark, d).select("id", "date"), path, rows_per_part=1000)
    cursor, found = (datetime(1998, 6, 1), 500), []
    for _ in range(3):
        found.append(pages.page(spark, path, after=cursor, limit=50))
        if not (rows := found[-1].collect()):
            break
        cursor = (rows[-1]["date"], rows[-1]["id"])
    return reduce(DataFrame.unionAll, found).select("id", ts("date").alias("date"))


@query("SELECT pos, e.id, message_id FROM (SELECT unnest([7, 3, 999999999, 12, 5]) AS id, generate_subscripts([7, 3, 999999999, 12, 5], 1) - 1 AS pos) w JOIN emails e ON e.id = w.id")
def records_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return messages.by_ids(_mails(spark, d), [7, 3, 999999999, 12, 5]).select("pos", "id", "message_id")


@query("SELECT e.id, CASE WHEN contains(lower(subject), 'urgent') THEN 'subject' WHEN contains(lower(body_text), 'urgent') THEN 'body' ELSE 'metadata' END AS field FROM emails e JOIN bodies b ON b.id = e.id WHERE contains(lower(body_text), 'urgent') OR contains(lower(subject), 'urgent')")
def mention_search(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.with_bodies(_mails(spark, d), spark, d).filter(mentions("URGENT"))
    return rows.select("id", messages.matched_field("URGENT").alias("field"))


TERMS = ("URGENT", "river", "ity of", "qz", "j", "No such words here")


@query(
    f", terms AS (SELECT unnest({list(TERMS)}) AS term) SELECT term, e.id, CASE WHEN contains(lower(subject), lower(term)) THEN 'subject' ELSE 'body' END AS field FROM emails e JOIN bodies b ON b.id = e.id, terms"
    " WHERE contains(lower(body_text), lower(term)) OR contains(lower(subject), lower(term))"
)
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """``mention_search`` for several terms, short ones too, over an index of the bodies and subjects."""
    path = fresh_path(spark, "keywords")
    mails, docs = staged(_mails(spark, d).select("id", "subject"), "mails"), archive.read(spark, d, "documents")
    subjects = mails.select(F.lit("subject").alias("field"), "id", F.col("subject").alias("text"))
    keywords.index_texts(docs.select(F.lit("body").alias("field"), F.col("doc_id").alias("id"), "text").unionAll(subjects), path, block_rows=1024, buckets=16)
    of_body = mails.select("id", (F.col("id") % docs.count()).alias("b_id"))
    found = []
    for term in TERMS:
        hits = keywords.keyword_search(spark, path, term, buckets=16)
        bodies = hits.filter("field = 'body'").select(F.col("id").alias("b_id")).join(of_body, "b_id").select("id", F.lit(2).alias("place"))
        places = hits.filter("field = 'subject'").select("id", F.lit(1).alias("place")).unionAll(bodies)
        found.append(places.groupBy("id").agg(F.min("place").alias("place")).select(F.lit(term).alias("term"), "id", F.when(F.col("place") == 1, "subject").otherwise("body").alias("field")))
    return reduce(DataFrame.unionAll, found)


@query("SELECT e.id, CASE WHEN p = 0 THEN substr(b, 1, 300) || CASE WHEN length(b) > 300 THEN '…' ELSE '' END ELSE (CASE WHEN greatest(1, p - 50) > 1 THEN '…' ELSE '' END) || substr(b, greatest(1, p - 50), 300) || (CASE WHEN length(b) >= greatest(1, p - 50) + 300 THEN '…' ELSE '' END) END AS snippet FROM (SELECT e.id, body_text AS b, strpos(lower(body_text), 'thing') AS p FROM emails e JOIN bodies b ON b.id = e.id) e")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.with_bodies(_mails(spark, d), spark, d)
    return rows.select("id", messages.snippet(F.col("body_text"), "thing").alias("snippet"))


@query("SELECT e.id, length(body_text) AS body_length, CASE WHEN length(body_text) > 80 THEN substr(body_text, 1, 80) || '...' ELSE body_text END AS body_text, length(body_text) > 80 AS body_truncated FROM emails e JOIN bodies b ON b.id = e.id")
def projected_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.with_bodies(_mails(spark, d), spark, d)
    return messages.projected(rows, ["id", "body_length", "body_text"], 80).withColumn("body_length", F.col("body_length").cast("long"))


@query(ORACLES["snippets"].removeprefix(archive.SQL))
def snippets_all(spark: SparkSession, d: str) -> DataFrame:
    """Another name of ``snippets``."""
    return snippets(spark, d)


@query(ORACLES["projected_fields"].removeprefix(archive.SQL))
def projected_fields_all(spark: SparkSession, d: str) -> DataFrame:
    """Another name of ``projected_fields``."""
    return projected_fields(spark, d)


@query("SELECT id FROM emails WHERE date >= '1996-01-01' AND date < '2000-01-01' AND source_account IN ('acct0', 'acct2') AND (sender_address IN ('u1@d1.example', 'u5@d0.example') OR list_has_any(to_l, ['u1@d1.example', 'u5@d0.example']) OR list_has_any(cc_l, ['u1@d1.example', 'u5@d0.example']) OR list_has_any(bcc_l, ['u1@d1.example', 'u5@d0.example']))")
def scope_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = scope_filter(date_from="1996-01-01", date_to="2000-01-01", mailboxes=["acct0", "acct2"], participants=["u1@d1.example", "u5@d0.example"])
    return _mails(spark, d).filter(where).select("id")


@query("SELECT id, recipient_address, recipient_domain, recipient_type FROM sent_to")
def view_sent_to(spark: SparkSession, d: str) -> DataFrame:
    return messages.participants(_mails(spark, d), "id").select("id", "recipient_address", "recipient_domain", "recipient_type")


@query("SELECT id, unnest(labels) AS label FROM emails")
def view_labels(spark: SparkSession, d: str) -> DataFrame:
    return messages.labels(_mails(spark, d), "id")


@query("SELECT e.id, a.source_account AS account FROM emails e JOIN email_accounts a ON a.email_id = e.id")
def view_accounts(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    accounts = archive.email_accounts(m).select(F.col("email_id").alias("id"), F.col("source_account").alias("account"))
    return m.select("id").join(accounts, "id")


INBOUND = "FROM emails e WHERE date IS NOT NULL AND sender_address NOT IN (SELECT address FROM me) AND NOT EXISTS (SELECT 1 FROM emails r WHERE r.thread_id = e.thread_id AND r.date > e.date AND r.sender_address IN (SELECT address FROM me))"
OUTBOUND = "FROM emails e WHERE date IS NOT NULL AND sender_address IN (SELECT address FROM me) AND "


@query(f"SELECT id, thread_id, sender_address, {TS.format('date')} AS date {INBOUND}")
def unreplied_inbound(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.unreplied(_mails(spark, d), archive.identities(spark, d))
    return rows.select("id", "thread_id", "sender_address", ts("date").alias("date"))


@query(f"SELECT id, thread_id {INBOUND} AND sender_domain = 'd2.example' AND date >= '1996-01-01'")
def unreplied_inbound_filtered(spark: SparkSession, d: str) -> DataFrame:
    return messages.unreplied(_mails(spark, d), archive.identities(spark, d), sender_domain="d2.example", after="1996-01-01").select("id", "thread_id")


@query(f"SELECT id, thread_id {INBOUND} AND sender_address IN (SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' FROM customer WHERE c_acctbal > 5000)")
def unreplied_human(spark: SparkSession, d: str) -> DataFrame:
    human = archive.read(spark, d, "customer").filter("c_acctbal > 5000").select(archive.addr(F.col("c_custkey")).alias("address"))
    return messages.unreplied(_mails(spark, d), archive.identities(spark, d), human=human).select("id", "thread_id")


@query(f"SELECT id, thread_id {OUTBOUND} NOT EXISTS (SELECT 1 FROM emails r WHERE r.thread_id = e.thread_id AND r.date > e.date AND r.sender_address NOT IN (SELECT address FROM me))")
def unreplied_outbound(spark: SparkSession, d: str) -> DataFrame:
    return messages.unreplied(_mails(spark, d), archive.identities(spark, d), direction="outbound").select("id", "thread_id")


@query(f"SELECT id, thread_id {OUTBOUND} list_contains(to_l || cc_l || bcc_l, 'u5@d0.example') AND NOT EXISTS (SELECT 1 FROM emails r WHERE r.thread_id = e.thread_id AND r.date > e.date AND r.sender_address = 'u5@d0.example')")
def unreplied_outbound_to(spark: SparkSession, d: str) -> DataFrame:
    return messages.unreplied(_mails(spark, d), archive.identities(spark, d), direction="outbound", recipient="u5@d0.example").select("id", "thread_id")


IN_ROWS = "SELECT sender_address AS address FROM emails WHERE sender_address NOT IN (SELECT address FROM me)"
OUT_ROWS = "SELECT recipient_address AS address FROM sent_to WHERE sender_address IN (SELECT address FROM me) AND recipient_address NOT IN (SELECT address FROM me)"
BOTH = f"({IN_ROWS} UNION ALL {OUT_ROWS})"


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    """Two addresses a contact, for the first half of the customers."""
    c = archive.read(spark, d, "customer").filter("c_custkey % 2 = 0 or c_custkey % 3 = 0")
    return c.select(archive.addr(F.col("c_custkey")).alias("address"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)).alias("contact_id"))


@query(f"SELECT address AS key, count(*) AS messages FROM ({IN_ROWS}) GROUP BY 1")
def top_contacts_inbound(spark: SparkSession, d: str) -> DataFrame:
    return messages.top_contacts(_mails(spark, d), archive.identities(spark, d), direction="inbound")


@query(f"SELECT address AS key, count(*) AS messages FROM ({OUT_ROWS}) GROUP BY 1")
def top_contacts_outbound(spark: SparkSession, d: str) -> DataFrame:
    return messages.top_contacts(_mails(spark, d), archive.identities(spark, d), direction="outbound")


@query(f"SELECT split_part(address, '@', 2) AS key, count(*) AS messages FROM {BOTH} WHERE split_part(address, '@', 2) NOT IN ('d4.example') GROUP BY 1")
def top_contacts_domain(spark: SparkSession, d: str) -> DataFrame:
    return messages.top_contacts(_mails(spark, d), archive.identities(spark, d), group_by="domain", exclude_domains=["d4.example"])


@query(f"SELECT coalesce(contact_id, b.address) AS key, count(*) AS messages FROM {BOTH} b LEFT JOIN (SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || (c_custkey // 2) AS contact_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0) c ON c.address = b.address GROUP BY 1 ORDER BY messages DESC, key LIMIT 50")
def top_contacts_contact(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.top_contacts(_mails(spark, d), archive.identities(spark, d), group_by="contact", contacts=_contacts(spark, d))
    return rows.orderBy(F.desc("messages"), "key").limit(50)


@query(f"SELECT a.source_account, count(DISTINCT email_id) AS messages, {TS.format('min(date)')} AS first_date, {TS.format('max(date)')} AS last_date, count(DISTINCT a.import_id) AS imports FROM email_accounts a JOIN emails e ON e.id = a.email_id GROUP BY 1")
def accounts(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    return messages.account_summary(m, archive.email_accounts(m)).withColumns({c: ts(c) for c in ("first_date", "last_date")})


@query(f"SELECT thread_id, count(*) AS messages, {TS.format('min(date)')} AS first_date, {TS.format('max(date)')} AS last_date, array_to_string(list_sort(list(DISTINCT sender_address)), '|') AS participants FROM emails GROUP BY 1 HAVING count(*) >= 4")
def long_threads(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.long_threads(_mails(spark, d), min_messages=4)
    return rows.select("thread_id", "messages", ts("first_date").alias("first_date"), ts("last_date").alias("last_date"), joined("participants").alias("participants"))


@query("SELECT id FROM emails WHERE sender_address IN ('u2@d2.example', 'u3@d3.example') OR list_has_any(to_l || cc_l || bcc_l, ['u2@d2.example', 'u3@d3.example'])")
def correspondence(spark: SparkSession, d: str) -> DataFrame:
    who = archive.read(spark, d, "customer").filter("c_custkey in (2, 3)").select(archive.addr(F.col("c_custkey")).alias("address"))
    return messages.correspondence(_mails(spark, d), who).select("id")


@query("SELECT 'mailbox' AS facet, source_account AS value, count(*) AS n FROM emails GROUP BY 2 UNION ALL SELECT 'year', year(date)::VARCHAR, count(*) FROM emails WHERE date IS NOT NULL GROUP BY 2 UNION ALL SELECT 'attachment', has_attachment::VARCHAR, count(*) FROM emails GROUP BY 2")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return messages.facets(_mails(spark, d))


@query("SELECT date_trunc('month', date)::DATE::VARCHAR AS month, sender_domain, count(*) AS n, count(DISTINCT sender_address) AS senders FROM emails WHERE date >= '1996-01-01' AND NOT (subject ILIKE 're:%') GROUP BY 1, 2 HAVING count(*) >= 12")
def spec_grouped(spark: SparkSession, d: str) -> DataFrame:
    s = {
        "where": {"and": [{"field": "date", "gte": "1996-01-01"}, {"not": {"field": "subject", "ilike": "re:%"}}]},
        "select": [{"date_trunc": "month", "field": "date", "as": "month"}, {"field": "sender_domain"}, {"count": "*", "as": "n"}, {"count_distinct": "sender_address", "as": "senders"}],
        "group_by": ["month", "sender_domain"],
        "having": {"field": "n", "op": "gte", "value": 12},
        "limit": 1000,
    }
    return spec.query(_mails(spark, d), s).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("SELECT id, subject AS title FROM emails WHERE (sender_domain IN ('d0.example', 'd1.example') OR list_has_all(labels, ['5-LOW'])) AND in_reply_to IS NOT NULL AND sender_address <> 'u5@d0.example' ORDER BY id LIMIT 300")
def spec_rows(spark: SparkSession, d: str) -> DataFrame:
    s = {
        "where": {"and": [{"or": [{"field": "sender_domain", "in": ["d0.example", "d1.example"]}, {"field": "labels", "contains": ["5-LOW"]}]}, {"field": "in_reply_to", "is_null": False}, {"field": "sender_address", "op": "neq", "value": "u5@d0.example"}]},
        "select": ["id", {"field": "subject", "as": "title"}],
        "order_by": [{"field": "id", "dir": "asc"}],
        "limit": 300,
    }
    return spec.query(_mails(spark, d), s)


@query(f"SELECT recipient_type, count(*) AS n, {TS.format('min(date)')} AS first_date, array_to_string(list_sort(list(DISTINCT sender_domain)), '|') AS domains FROM sent_to GROUP BY 1")
def spec_sent_to(spark: SparkSession, d: str) -> DataFrame:
    view = messages.participants(_mails(spark, d), "id", "date", "sender_domain")
    s = {"select": [{"field": "recipient_type"}, {"count": "*", "as": "n"}, {"min": "date", "as": "first_date"}, {"array_agg_distinct": "sender_domain", "as": "domains"}], "group_by": ["recipient_type"]}
    return spec.query(view, s).select("recipient_type", "n", ts("first_date").alias("first_date"), joined("domains").alias("domains"))


SEEN = "date >= '1995-01-01' AND date < '1999-01-01'"


@query(f"SELECT 'messages' AS lane, {TS.format(chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', date)')} AS bucket, count(*) AS n FROM emails WHERE {SEEN} GROUP BY 2 UNION ALL SELECT 'attachments', strftime(date_trunc('month', date), '%Y-%m-%d %H:%M:%S'), count(*) FROM bridge b JOIN emails e ON e.id = b.email_id WHERE {SEEN} GROUP BY 2 UNION ALL SELECT 'people', strftime(date_trunc('month', date), '%Y-%m-%d %H:%M:%S'), count(DISTINCT sender_address) FROM emails WHERE {SEEN} GROUP BY 2 UNION ALL SELECT 'density', strftime(date_trunc('month', date), '%Y-%m-%d %H:%M:%S'), count(*) FROM emails WHERE date IS NOT NULL GROUP BY 2")
def timeline_lanes(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    rows = timeline.lanes(m, archive.bridge(archive.attachment_lines(spark, d)), after=RANGE[0], before=RANGE[1], unit="month")
    return rows.select("lane", ts("bucket").alias("bucket"), "n")


@query("SELECT strftime(date_trunc('quarter', date), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, count(DISTINCT sender_address) AS people FROM emails WHERE date IS NOT NULL GROUP BY 1")
def timeline_quarters(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    both = timeline.message_lane(m, "quarter").join(timeline.people_lane(m, "quarter").withColumnRenamed("n", "people"), "bucket")
    return both.select(ts("bucket").alias("bucket"), "n", "people")


@query("SELECT strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last_date FROM emails")
def timeline_extent(spark: SparkSession, d: str) -> DataFrame:
    return timeline.extent(_mails(spark, d)).select(ts("first_date").alias("first_date"), ts("last_date").alias("last_date"))


@query("SELECT sender_address, strftime(date_trunc('year', date), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM emails WHERE date IS NOT NULL AND sender_address IN (SELECT sender_address FROM emails WHERE date IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) GROUP BY 1, 2")
def timeline_top_people(spark: SparkSession, d: str) -> DataFrame:
    return timeline.top_series(_mails(spark, d), "sender_address", "year", 8).select("sender_address", ts("bucket").alias("bucket"), "n")


@query("SELECT range, strftime(date_trunc('month', date), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM (SELECT 'a' AS range, date FROM emails WHERE date >= '1996-01-01' AND date < '1997-01-01' UNION ALL SELECT 'b', date FROM emails WHERE date >= '1996-07-01' AND date < '1998-01-01') GROUP BY 1, 2")
def timeline_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.compare(_mails(spark, d), ("1996-01-01", "1997-01-01"), ("1996-07-01", "1998-01-01"), "month")
    return rows.select("range", ts("bucket").alias("bucket"), "n")


@query("SELECT sender_domain, strftime(date_trunc('year', date), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sender_domain), 6)::DOUBLE AS share FROM emails WHERE date IS NOT NULL GROUP BY 1, 2")
def timeline_shares(spark: SparkSession, d: str) -> DataFrame:
    series = timeline.top_series(_mails(spark, d), "sender_domain", "year", 10)
    return timeline.shares(series, "sender_domain").select("sender_domain", ts("bucket").alias("bucket"), "n", F.round("share", 6).alias("share"))


@query("SELECT sender_domain, year(date)::INT AS year, count(*) AS n FROM emails WHERE date IS NOT NULL GROUP BY CUBE (1, 2)")
def year_matrix(spark: SparkSession, d: str) -> DataFrame:
    return timeline.matrix(_mails(spark, d), "sender_domain")


@query("SELECT content_type, CASE content_type WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image' WHEN 'text/csv' THEN 'spreadsheet' WHEN 'application/msword' THEN 'document' ELSE 'other' END AS family, count(*) AS n FROM attachments GROUP BY 1, 2")
def attachment_families(spark: SparkSession, d: str) -> DataFrame:
    atts = archive.attachments(archive.attachment_lines(spark, d))
    return atts.groupBy("content_type", content_family(F.col("content_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (len(v) > 0 AND list_inner_product(v, v) > 0) AS usable, count(*) FILTER (v IS NULL) AS missing FROM vectors")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.with_vectors(_mails(spark, d), spark, d)
    return rows.agg(F.count_if(norm("embedding") > 0).alias("usable"), F.count_if(F.col("embedding").isNull()).alias("missing"))
