"""Contacts, threads and retrieval over the archive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.vectors import literal
from lettermill.operators import contacts, retrieval, threads, vector_store
from lettermill.operators.predicates import mentions, scope_filter
from lettermill.plans.registry import ORACLES, joined, query, ts
from lettermill.sources import archive
from lettermill.staging import fresh_path, staged

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format

BOOK = """,
sent AS (SELECT sender_address AS address, count(*) AS n, min(date) AS f, max(date) AS l, min(sender_name) AS name FROM emails GROUP BY 1),
got AS (SELECT address, count(*) AS n, min(date) AS f, max(date) AS l FROM (SELECT DISTINCT id, date, recipient_address AS address FROM sent_to WHERE sender_address IN (SELECT address FROM me)) GROUP BY 1),
book AS (SELECT coalesce(s.address, g.address) AS address, s.name, coalesce(s.address, g.address) IN (SELECT address FROM me) AS is_user, least(s.f, g.f) AS first_seen, greatest(s.l, g.l) AS last_seen, coalesce(s.n, 0) AS messages_from, coalesce(g.n, 0) AS messages_to FROM sent s FULL JOIN got g ON g.address = s.address)
"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    return contacts.address_book(archive.emails(spark, d), archive.identities(spark, d))


@query(BOOK + f"SELECT address, name, is_user, {STAMP('first_seen')} AS first_seen, {STAMP('last_seen')} AS last_seen, messages_from, messages_to FROM book")
def address_book(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select("address", "name", "is_user", ts("first_seen").alias("first_seen"), ts("last_seen").alias("last_seen"), "messages_from", "messages_to")


@query(ORACLES["address_book"].removeprefix(archive.SQL))
def stream_address_book(spark: SparkSession, d: str) -> DataFrame:
    """The same book, upserted import by import from a stream of messages."""
    from lettermill.streaming import jobs, stores

    path = fresh_path(spark, "book")
    mails = archive.emails(spark, d).select("sender_address", "sender_name", "recipients", "date", "import_id")
    me = staged(archive.identities(spark, d), "me")
    for k in range(4):
        mails.filter(F.col("import_id") == f"imp{k}").write.mode("append").parquet(f"{path}/in")
        jobs.each_batch(jobs.read_files(spark, f"{path}/in", mails.schema), stores.upsert_statistics(path, me, buckets=16), f"{path}/checkpoint").awaitTermination()
    book = jobs.book_of_statistics(stores.running_statistics(spark, path), me)
    return book.select("address", "name", "is_user", ts("first_seen").alias("first_seen"), ts("last_seen").alias("last_seen"), "messages_from", "messages_to")


@query(BOOK + ", touched AS (SELECT sender_address AS address FROM emails WHERE import_id = 'imp1' UNION SELECT recipient_address FROM sent_to s JOIN emails e ON e.id = s.id WHERE e.import_id = 'imp1' AND s.sender_address IN (SELECT address FROM me)) SELECT address, messages_from, messages_to FROM book WHERE address IN (SELECT address FROM touched)")
def address_book_of_import(spark: SparkSession, d: str) -> DataFrame:
    m, me = archive.emails(spark, d), archive.identities(spark, d)
    only = contacts.touched_addresses(m.filter("import_id = 'imp1'"), me)
    return contacts.address_book(m, me, only=only).select("address", "messages_from", "messages_to")


@query(
    BOOK
    + """, sizes AS (SELECT thread_id, count(*) AS n FROM emails GROUP BY 1),
mine AS (SELECT DISTINCT thread_id FROM emails WHERE sender_address IN (SELECT address FROM me)),
stats AS (SELECT sender_address AS address, sum(n) / count(*) AS depth, count(m.thread_id) / count(*) AS ratio FROM emails e JOIN sizes s USING (thread_id) LEFT JOIN mine m USING (thread_id) GROUP BY 1)
SELECT b.address, round(greatest(0.01, least(0.99, 0.5::DOUBLE + CASE WHEN messages_from > 0 AND messages_to > 0 THEN 0.35 ELSE 0 END + CASE WHEN messages_to > 0 THEN 0.15 ELSE 0 END
 + CASE WHEN messages_from >= 20 AND messages_to = 0 THEN -0.2 ELSE 0 END + CASE WHEN ratio >= 0.3 THEN 0.25 ELSE 0 END + CASE WHEN depth < 1.5 AND messages_from >= 10 THEN -0.15 ELSE 0 END + CASE WHEN depth >= 3 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS human_probability
FROM book b LEFT JOIN stats USING (address) WHERE NOT is_user"""
)
def human_probability(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    scores = contacts.human_probability(book, archive.emails(spark, d), archive.identities(spark, d))
    return book.select("address", "contact_id").join(scores, "contact_id").select("address", "human_probability")


@query(BOOK + ", scored AS (SELECT CASE WHEN messages_from > 0 AND messages_to > 0 THEN 'high' WHEN messages_to > 0 THEN 'middle' ELSE 'low' END AS band FROM book WHERE NOT is_user) SELECT band, count(*) AS n FROM scored GROUP BY 1")
def contact_bands(spark: SparkSession, d: str) -> DataFrame:
    c = contacts.rollup(_book(spark, d)).filter("not only_user")
    band = F.when((F.col("messages_from") > 0) & (F.col("messages_to") > 0), "high").when(F.col("messages_to") > 0, "middle").otherwise("low")
    return c.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(BOOK + "SELECT address AS primary_address, (messages_from + messages_to)::DOUBLE AS rank_key FROM book WHERE NOT is_user AND (contains(lower(name), '01') OR contains(address, '01'))")
def contact_search(spark: SparkSession, d: str) -> DataFrame:
    cards = contacts.rollup(_book(spark, d)).withColumns({"kind": F.lit("unknown"), "tags": F.array(), "human_probability": F.lit(0.5)})
    return contacts.search(cards, text="01").select("primary_address", "rank_key")


@query(BOOK + ", cards AS (SELECT address, messages_from + messages_to AS n, 'name ' || (substr(split_part(address, '@', 1), 2)::BIGINT % 300) AS k FROM book WHERE NOT is_user AND messages_from + messages_to >= 2) SELECT least(a.address, b.address) AS address_a, greatest(a.address, b.address) AS address_b, replace(a.k, ' ', '') AS name_key, a.n + b.n AS volume FROM cards a JOIN cards b ON a.k = b.k AND a.address < b.address")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.split_part(F.substring("address", 2, 20), F.lit("@"), F.lit(1)).cast("long") % 300
    book = _book(spark, d).withColumns({"name_variants": F.array(F.concat(F.lit("Name "), k)), "contact_id": F.col("address")})  # pairs in the order of addresses
    return contacts.merge_candidates(book).select(F.col("id_a").alias("address_a"), F.col("id_b").alias("address_b"), "name_key", "volume")


@query(BOOK + """, keyed AS (SELECT address, messages_from + messages_to AS n, 'name' || (substr(split_part(address, '@', 1), 2)::BIGINT % 300) AS name_key, 'ct_' || substr(sha256(address), 1, 16) AS c FROM book WHERE NOT is_user AND messages_from + messages_to >= 2),
w AS (SELECT *, count(*) OVER (PARTITION BY name_key) AS members, first_value(address) OVER o AS representative, first_value(n) OVER o AS most FROM keyed WINDOW o AS (PARTITION BY name_key ORDER BY n DESC, c))
SELECT name_key, address, representative, members, CASE WHEN address = representative THEN n ELSE n + most END AS volume FROM w WHERE members > 1""")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.split_part(F.substring("address", 2, 20), F.lit("@"), F.lit(1)).cast("long") % 300
    book = _book(spark, d).withColumn("name_variants", F.array(F.concat(F.lit("Name "), k)))
    of = lambda c, to: book.select(F.col("contact_id").alias(c), F.col("address").alias(to))
    named = contacts.merge_groups(book).join(of("contact_id", "address"), "contact_id").withColumnRenamed("representative", "r").join(of("r", "representative"), "r")
    return named.select("name_key", "address", "representative", "members", "volume")


MERGED = ", c AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, c_name AS display_name, c_mktsegment AS tag FROM customer)"


def _contact_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = archive.read(spark, d, "customer")
    ident = F.concat(F.lit("c"), F.col("c_custkey"))
    rows = c.select(ident.alias("id"), F.col("c_name").alias("display_name"), F.when(F.col("c_custkey") % 10 == 1, "human").otherwise("unknown").alias("kind"), F.when(F.col("c_custkey") % 10 == 1, "manual").otherwise("auto").alias("kind_source"), F.array("c_mktsegment").alias("tags"), F.lit("").alias("notes"))
    book = c.select(archive.addr(F.col("c_custkey")).alias("address"), ident.alias("contact_id"))
    merges = c.filter("c_custkey % 10 = 1").select(ident.alias("source_id"), F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("target_id"))
    return rows, book, merges


@query(MERGED + "SELECT t.id, t.display_name, CASE WHEN s.k IS NOT NULL THEN 'human' WHEN t.k % 10 = 1 THEN 'human' ELSE 'unknown' END AS kind, CASE WHEN s.tag IS NULL OR s.tag = t.tag THEN t.tag ELSE t.tag || '|' || s.tag END AS tags FROM c t LEFT JOIN c s ON s.k = t.k + 1 AND s.k % 10 = 1 WHERE t.k % 10 <> 1")
def merged_contacts(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = contacts.merge(*_contact_rows(spark, d))
    return rows.select("id", "display_name", "kind", joined("tags").alias("tags"))


@query("SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS contact_id FROM customer", over="tables")
def merged_addresses(spark: SparkSession, d: str) -> DataFrame:
    return contacts.merge(*_contact_rows(spark, d))[1].select("address", "contact_id")


@query("SELECT 'u' || c_custkey || '@d' || (c_custkey % 5) || '.example' AS address, 'c' || c_custkey AS contact_id FROM customer", over="tables")
def unmerged_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows, book, snapshots = contacts.merge(*_contact_rows(spark, d))
    return contacts.unmerge(rows, book, snapshots)[1].select("address", "contact_id")


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 5 = 3 THEN 'organization' WHEN c_custkey % 10 = 1 THEN 'human' ELSE 'unknown' END AS kind, CASE WHEN c_custkey % 5 = 3 OR c_custkey % 10 = 1 THEN 'manual' ELSE 'auto' END AS kind_source FROM customer", over="tables")
def bulk_kind(spark: SparkSession, d: str) -> DataFrame:
    rows, book, _ = _contact_rows(spark, d)
    return contacts.set_kind(rows, book, "organization", domain="d3.example")[0].select("id", "kind", "kind_source")




@query(
    archive.SQL.replace("WITH nc AS", "WITH RECURSIVE nc AS", 1)
    + """, links AS (SELECT message_id AS a, in_reply_to AS b FROM emails WHERE in_reply_to IS NOT NULL UNION SELECT in_reply_to, message_id FROM emails WHERE in_reply_to IS NOT NULL),
reach(n, r) AS (SELECT message_id, message_id FROM emails UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY 1),
roots AS (SELECT c, first(message_id ORDER BY date IS NULL, date, message_id) AS root FROM comp JOIN emails ON message_id = n GROUP BY 1)
SELECT id, coalesce(in_reply_to, message_id) AS old_thread_id, root AS new_thread_id FROM emails JOIN comp ON n = message_id JOIN roots USING (c) WHERE root <> coalesce(in_reply_to, message_id)""",
    over="tables",
)
def repaired_threads(spark: SparkSession, d: str) -> DataFrame:
    refs = F.when(F.col("in_reply_to").isNotNull(), F.array("in_reply_to")).otherwise(F.array().cast("array<string>"))
    m = archive.emails(spark, d).withColumn("references", refs)
    return threads.repaired_threads(m.withColumn("thread_id", threads.derived_thread_id())).select("id", "old_thread_id", "new_thread_id")


@query(
    f""", ego AS (SELECT 'u7@d2.example' AS address UNION SELECT 'u8@d3.example'),
shared AS (SELECT thread_id FROM emails WHERE sender_address IN (SELECT address FROM ego) UNION SELECT thread_id FROM sent_to WHERE recipient_address IN (SELECT address FROM ego)),
near AS (SELECT sender_address AS node, thread_id, date FROM emails WHERE thread_id IN (SELECT thread_id FROM shared) AND sender_address NOT IN (SELECT address FROM ego))
SELECT node, count(DISTINCT thread_id) AS shared_threads, {STAMP('min(date)')} AS first_shared, {STAMP('max(date)')} AS last_shared, (SELECT count(DISTINCT node) FROM near) AS total_nodes FROM near GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""
)
def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    ego = archive.read(spark, d, "customer").filter("c_custkey in (7, 8)").select(archive.addr(F.col("c_custkey")).alias("address"))
    none = spark.createDataFrame([], "address string, contact_id string")
    g = threads.ego_graph(archive.emails(spark, d), ego, none, max_nodes=30)
    return g.select("node", "shared_threads", ts("first_shared").alias("first_shared"), ts("last_shared").alias("last_shared"), "total_nodes")


@query("SELECT a.sender_address AS a, b.sender_address AS b, count(DISTINCT a.thread_id) AS shared_threads FROM emails a JOIN emails b ON a.thread_id = b.thread_id AND a.sender_address < b.sender_address GROUP BY 1, 2 HAVING count(DISTINCT a.thread_id) >= 2")
def co_participation(spark: SparkSession, d: str) -> DataFrame:
    return threads.co_participation(archive.emails(spark, d), least=2)


@query("WITH RECURSIVE t(id, path, depth) AS (SELECT n_nationkey, n_nationkey::VARCHAR, 0 FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, path || ' > ' || n_nationkey, depth + 1 FROM nation JOIN t ON t.id = n_nationkey // 5 WHERE n_nationkey >= 5) SELECT id, path, depth FROM t", over="tables")
def topic_tree(spark: SparkSession, d: str) -> DataFrame:
    nodes = archive.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 5, F.floor(F.col("n_nationkey") / 5).cast("int")).alias("parent_id"))
    return threads.tree_paths(nodes)


def _query_vector(spark: SparkSession, d: str, vec_id: int = 3) -> list[float]:
    return list(archive.read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)"


@query(f"SELECT id, round(list_cosine_similarity(v, {Q}), 6) AS similarity FROM vectors JOIN emails USING (id) WHERE date >= '1996-01-01' AND sender_domain <> 'd9.example' AND has_attachment ORDER BY list_cosine_similarity(v, {Q}) DESC, id LIMIT 60")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    m = archive.with_vectors(archive.emails(spark, d), spark, d)
    return retrieval.semantic_search(m, _query_vector(spark, d), limit=60, after="1996-01-01", has_attachment=True).select("id", F.round("similarity", 6).alias("similarity"))


@query(ORACLES["semantic_search"].removeprefix(archive.SQL))
def stored_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """``semantic_search`` over stored vectors, as matrix products."""
    path = fresh_path(spark, "vectors")
    mails = archive.emails(spark, d).select("id", "date", "has_attachment")
    vector_store.store_vectors(archive.with_vectors(mails, spark, d), path)
    found = vector_store.stored_search(spark, path, _query_vector(spark, d), limit=60, after="1996-01-01", has_attachment=True)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = archive.attachment_lines(spark, d)
    contents = archive.contents(archive.attachments(lines))
    vectors = archive.read(spark, d, "embeddings")
    n = vectors.count()
    chunks = contents.filter("n_chunks > 0").select("sha256", F.explode(F.sequence(F.lit(0), (F.col("n_chunks") - 1).cast("int"))).alias("chunk_index"))
    key = F.conv(F.substring("sha256", 1, 6), 16, 10).cast("long")
    rows = chunks.withColumn("vec_id", (key + F.col("chunk_index")) % n).join(vectors.select("vec_id", "embedding"), "vec_id")
    return rows, contents, archive.bridge(lines)


CHUNKS = ", chunks AS (SELECT sha256, unnest(range(n_chunks)) AS chunk_index, ('0x' || substr(sha256, 1, 6))::BIGINT AS n FROM contents), near AS (SELECT c.sha256, c.chunk_index, list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS s FROM chunks c JOIN embeddings v ON v.vec_id = (c.n + c.chunk_index) % (SELECT count(*) FROM embeddings))"


@query(CHUNKS + " SELECT n.sha256, n.chunk_index::INT AS chunk_index, round(s, 6) AS similarity, (SELECT count(DISTINCT email_id) FROM bridge b WHERE b.sha256 = n.sha256) AS parents FROM near n JOIN contents c ON c.sha256 = n.sha256 WHERE c.status = 'extracted' AND n.sha256 IN (SELECT sha256 FROM bridge b JOIN emails e ON e.id = b.email_id WHERE e.sender_domain = 'd2.example') ORDER BY s DESC, n.sha256, n.chunk_index LIMIT 40")
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    chunks, contents, bridge = _chunks(spark, d)
    rows = retrieval.chunk_search(chunks, contents, bridge, archive.emails(spark, d), _query_vector(spark, d), limit=40, sender_domain="d2.example")
    return rows.select("sha256", "chunk_index", F.round("similarity", 6).alias("similarity"), F.size("email_ids").cast("long").alias("parents"))


@query(CHUNKS + f""", lists AS (SELECT 'message' AS source, id::VARCHAR AS id, list_cosine_similarity(v, {Q}) AS s FROM vectors ORDER BY s DESC, vectors.id::VARCHAR LIMIT 30),
atts AS (SELECT 'attachment' AS source, sha256 || ':' || chunk_index AS id, s FROM near ORDER BY s DESC, id LIMIT 30),
r AS (SELECT source, id, s, row_number() OVER (PARTITION BY source ORDER BY s DESC, id) AS rank FROM (SELECT * FROM lists UNION ALL SELECT * FROM atts))
SELECT source, id, rank::INT AS rank, round(1 / (60 + rank), 9)::DOUBLE AS score FROM r ORDER BY 1 / (60 + rank) DESC, s DESC, source, id LIMIT 20""")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    v = literal(_query_vector(spark, d))
    m = archive.with_vectors(archive.emails(spark, d).select("id"), spark, d)
    near = lambda t, source, key: t.filter(retrieval.usable()).select(F.lit(source).alias("source"), key.alias("id"), retrieval.cosine("embedding", v).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(30)
    lists = near(m, "message", F.col("id").cast("string")).unionByName(near(_chunks(spark, d)[0], "attachment", F.concat_ws(":", "sha256", "chunk_index")))
    return retrieval.fuse_sources(lists).select("source", "id", "rank", F.round("score", 9).alias("score"))


@query(CHUNKS + " SELECT source, id, rank::INT AS rank, round(1 / (60 + rank), 9)::DOUBLE AS score FROM (SELECT 'attachment' AS source, sha256 || ':' || chunk_index AS id, s, row_number() OVER (ORDER BY s DESC, sha256 || ':' || chunk_index) AS rank FROM near) ORDER BY s DESC, id LIMIT 20")
def search_attachments(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)[0].filter(retrieval.usable())
    near = rows.select(F.lit("attachment").alias("source"), F.concat_ws(":", "sha256", "chunk_index").alias("id"), retrieval.cosine("embedding", literal(_query_vector(spark, d))).alias("similarity"))
    messages = near.limit(0).withColumn("source", F.lit("message"))
    lists = near.orderBy(F.desc("similarity"), "id").limit(30).unionByName(messages)
    return retrieval.fuse_sources(lists, sources=["attachment"]).select("source", "id", "rank", F.round("score", 9).alias("score"))


@query(f""", hit AS (SELECT e.id, subject, sender_address, date FROM emails e JOIN bodies b ON b.id = e.id WHERE contains(lower(body_text), 'thing') OR contains(lower(subject), 'thing')),
x AS (SELECT id, row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS r FROM hit QUALIFY r <= 200),
n AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(v, {Q}) DESC, id) AS r FROM vectors QUALIFY r <= 200),
f AS (SELECT coalesce(x.id, n.id) AS id, coalesce(1 / (60 + x.r), 0) + coalesce(1 / (60 + n.r), 0) + CASE WHEN x.id IS NOT NULL AND n.id IS NOT NULL THEN 1 / 60 ELSE 0 END AS s FROM x FULL JOIN n ON n.id = x.id),
u AS (SELECT e.id, s, count(*) OVER w - 1 AS suppressed, row_number() OVER (PARTITION BY subject, sender_address, date ORDER BY s DESC, e.id) AS k FROM f JOIN emails e ON e.id = f.id WINDOW w AS (PARTITION BY subject, sender_address, date))
SELECT id, round(s, 9)::DOUBLE AS score, suppressed FROM u WHERE k = 1 ORDER BY s DESC, id LIMIT 25""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    texts = archive.with_bodies(m.select("id", "date", "subject"), spark, d)
    rows = retrieval.hybrid_search(m, mentions("thing"), _query_vector(spark, d), window=200, texts=texts, vectors=archive.with_vectors(m.select("id"), spark, d))
    return rows.select("id", F.round("score", 9).alias("score"), "suppressed")


@query(f""", inside AS (SELECT id, subject, sender_address, date FROM emails WHERE date >= '1996-01-01' AND date < '1998-01-01' AND source_account IN ('acct0', 'acct1')),
hit AS (SELECT e.* FROM inside e JOIN bodies b ON b.id = e.id WHERE contains(lower(body_text), 'thing') OR contains(lower(subject), 'thing')),
x AS (SELECT id, row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS r FROM hit QUALIFY r <= 100),
n AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(v, {Q}) DESC, id) AS r FROM vectors JOIN inside USING (id) QUALIFY r <= 100),
f AS (SELECT coalesce(x.id, n.id) AS id, coalesce(1 / (60 + x.r), 0) + coalesce(1 / (60 + n.r), 0) + CASE WHEN x.id IS NOT NULL AND n.id IS NOT NULL THEN 1 / 60 ELSE 0 END AS s FROM x FULL JOIN n ON n.id = x.id),
u AS (SELECT e.id, s, count(*) OVER w - 1 AS suppressed, row_number() OVER (PARTITION BY subject, sender_address, date ORDER BY s DESC, e.id) AS k FROM f JOIN emails e ON e.id = f.id WINDOW w AS (PARTITION BY subject, sender_address, date))
SELECT id, round(s, 9)::DOUBLE AS score, suppressed FROM u WHERE k = 1 ORDER BY s DESC, id LIMIT 25""")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    m = archive.emails(spark, d)
    scope = scope_filter(date_from="1996-01-01", date_to="1998-01-01", mailboxes=["acct0", "acct1"])
    texts = archive.with_bodies(m.select("id", "date", "subject"), spark, d)
    rows = retrieval.hybrid_search(m, mentions("thing"), _query_vector(spark, d), window=100, scope=scope, texts=texts, vectors=archive.with_vectors(m.select("id"), spark, d))
    return rows.select("id", F.round("score", 9).alias("score"), "suppressed")


@query()
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    m = archive.with_vectors(archive.emails(spark, d).select("id", "date", "sender_domain"), spark, d)
    return retrieval.diverse_sample(m, "sender_domain", 5)


@query()
def diverse_overall(spark: SparkSession, d: str) -> DataFrame:
    m = archive.with_vectors(archive.emails(spark, d).select("id", "date"), spark, d)
    return retrieval.diverse_overall(m, 12)


@query()
def cell_search(spark: SparkSession, d: str) -> DataFrame:
    from lettermill.staging import shared_dir

    rows = archive.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cells = retrieval.VectorCells(rows, f"{shared_dir(spark)}/cells-{rows.count()}")
    return cells.nearest(rows.filter("id % 100 = 0"), limit=20, probes=8).select("query_id", "id", F.round("similarity", 6).alias("similarity"))
