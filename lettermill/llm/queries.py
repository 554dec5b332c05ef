"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.bpe import encode
from lettermill.llm.chat import chat_digests, chat_windows
from lettermill.llm.decontamination import benchmark_leaks
from lettermill.llm.fill_middle import fill_middle
from lettermill.llm.language import language_id
from lettermill.llm.licenses import SLACK, TEMPLATES, TERM, license_scan
from lettermill.llm.line_dedup import line_dedup
from lettermill.llm.near_dup import near_duplicates
from lettermill.llm.phrases import phrase_collocations
from lettermill.llm.quality_model import quality_scores
from lettermill.llm.quality_rules import quality_rules
from lettermill.llm.substring_dedup import substring_dedup
from lettermill.llm.toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the byte-level vocabulary of the registered queries lies; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encode(table(spark, sf_dir, "documents"), vocabulary(), with_text=True)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a tree of source / thousands / hundreds, where every tenth file is its directory's LICENSE."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), name)
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")), carry=("doc_id",))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(chat_windows(rows.unionAll(added)))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points as units; 90 of 100 texts transformed, 20 of 100 of these suffix first."""
    made = fill_middle(table(spark, sf_dir, "documents"), seed=1, fim_percent=90, spm_percent=20, with_restored=True)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"), width=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents"), min_count=30, max_words=4, nested_percent=80, top=2000)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_licenses, op4_chat, op5_quality_model, op6_quality_rules, op7_language, op8_decontamination, op9_toxicity, op10_near_dup, op11_fill_middle, op12_substring_dedup, op13_phrases)}

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": rf"""
WITH tw AS (SELECT row_number() OVER () AS m, license_id, regexp_extract_all(lower(text), '{TERM}') AS w FROM (VALUES {_TEMPLATE_ROWS}) v(license_id, text)),
tt AS (SELECT m, license_id, len(w) AS size, term, len(list_filter(w, lambda y: y = term)) AS n, list_position(w, term) - 1 AS p FROM (SELECT *, unnest(list_distinct(w)) AS term FROM tw)),
files AS (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS files FROM files),
occ AS (SELECT * FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS at FROM files) WHERE term IN (SELECT term FROM tt)),
df AS (SELECT term, count(DISTINCT doc_id) AS held FROM occ GROUP BY 1),
weighed AS (SELECT tt.*, ln((1 + files) / (1 + coalesce(held, 0))) + 1 AS idf FROM tt CROSS JOIN total LEFT JOIN df ON df.term = tt.term),
unit AS (SELECT *, (1 + ln(n)) * idf AS x, (1 + ln(n)) * idf / sqrt(sum(pow((1 + ln(n)) * idf, 2)) OVER (PARTITION BY m)) AS u FROM weighed),
r AS (SELECT *, sum(u * u) OVER (PARTITION BY m ORDER BY x DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM unit),
cand AS (SELECT o.doc_id, m FROM (SELECT DISTINCT doc_id, term FROM occ) o JOIN r ON r.term = o.term WHERE rest >= {SLACK} GROUP BY 1, 2 HAVING sum(u * u) >= 0.36 - {SLACK}),
starts AS (SELECT DISTINCT o.doc_id, r.m, o.at - r.p AS s, r.size FROM occ o JOIN r ON r.term = o.term JOIN cand c ON c.doc_id = o.doc_id AND c.m = r.m WHERE rest >= 0.36),
win AS (SELECT t.doc_id, m, s, list_slice(w, greatest(s, 0) + 1, s + size) AS words FROM starts t JOIN files f ON f.doc_id = t.doc_id),
counted AS (SELECT doc_id, m, s, size, license_id, len(words) AS long, idf, u, len(list_filter(words, lambda x: x = term)) AS held FROM (SELECT win.*, r.size, r.license_id, r.term, r.idf, r.u FROM win JOIN r ON r.m = win.m)),
scored AS (SELECT doc_id, license_id, size, round(sum(CASE WHEN held > 0 THEN (1 + ln(held)) * idf * u ELSE 0 END) / sqrt(sum(CASE WHEN held > 0 THEN pow((1 + ln(held)) * idf, 2) - held ELSE 0 END) + any_value(long)), 9) AS cosine FROM counted GROUP BY doc_id, m, s, license_id, size),
own AS (SELECT doc_id, first(license_id ORDER BY cosine DESC, size DESC, license_id DESC) AS license_id, max(cosine) AS cosine FROM scored WHERE cosine >= 0.6 GROUP BY 1),
paths AS (SELECT doc_id, concat_ws('/', source, doc_id // 1000, doc_id // 100) AS dir, concat_ws('/', source, doc_id // 1000, doc_id // 100, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path FROM documents),
near AS (SELECT dir, first(license_id ORDER BY cosine DESC, license_id DESC) AS dir_license FROM paths JOIN own USING (doc_id) WHERE doc_id % 10 = 0 GROUP BY 1)
SELECT path, p.doc_id, coalesce(license_id, dir_license) AS license_id, cosine, CASE WHEN license_id IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS how, CASE WHEN license_id IS NULL AND dir_license IS NOT NULL THEN p.dir END AS from_dir
FROM paths p LEFT JOIN own o ON o.doc_id = p.doc_id LEFT JOIN near n ON n.dir = p.dir
""",
    "op2_line_dedup": """
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_chat": r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, (ceil((strlen(coalesce(role, '')) + strlen(coalesce(text, ''))) / 4) + 4)::BIGINT AS tokens FROM said),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
rules AS (SELECT conv_id, min(pos) AS s_pos FROM ranked WHERE role = 'system' GROUP BY 1),
sized AS (SELECT r.*, x.s_pos, greatest(1, floor(greatest(1, 2048 - 256 - coalesce(s.tokens, 0)) / 2))::BIGINT AS half FROM ranked r LEFT JOIN rules x ON x.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN ranked s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.pos = x.s_pos),
placed AS (SELECT *, coalesce(sum(tokens) OVER w, 0)::BIGINT AS before, coalesce(sum((tokens > half)::INT) OVER w, 0)::BIGINT AS long_before FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
keyed AS (SELECT *, before // half AS part, 2 * long_before + (tokens > half)::INT AS long_key, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM placed),
spans AS (SELECT conv_id, part, long_key, min(before) AS span FROM keyed GROUP BY 1, 2, 3),
own AS (SELECT conv_id, sum(chars) AS c FROM keyed GROUP BY 1),
past AS (SELECT k.conv_id, sum(chars) AS c FROM keyed k JOIN spans p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.span >= k.before + k.tokens AND p.span <= k.before + 256 WHERE k.tokens <= 256 AND k.pos IS DISTINCT FROM k.s_pos GROUP BY 1),
kept AS (SELECT k.conv_id, sum(chars) AS c FROM keyed k JOIN spans p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.span > k.before WHERE k.pos = k.s_pos GROUP BY 1),
digests AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS lost FROM ranked GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, (own.c + coalesce(past.c, 0) + coalesce(kept.c, 0))::BIGINT AS formatted_chars
FROM digests d JOIN own ON own.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN past ON past.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN kept ON kept.conv_id IS NOT DISTINCT FROM d.conv_id
""",
    "op10_near_dup": r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(n, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN both_ways l ON l.a = reach.n),
found AS (SELECT n, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN found f ON f.n = d.doc_id
""",
    "op11_fill_middle": """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, text, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM texts),
cut AS (SELECT doc_id, text, n, least(c1, c2) AS low, greatest(c1, c2) AS high, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""",
    "op12_substring_dedup": r"""
WITH said AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM said)),
firsts AS (SELECT k, min(doc_id) AS owner FROM starts GROUP BY 1),
known AS (SELECT s.doc_id, i FROM starts s JOIN firsts f USING (k) WHERE f.owner < s.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM said),
marked AS (SELECT w.doc_id, w.i, word, max(k.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS last FROM words w LEFT JOIN known k ON k.doc_id = w.doc_id AND k.i = w.i),
gone AS (SELECT doc_id, count(*) AS n_removed FROM marked WHERE i - last <= 49 GROUP BY 1),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM marked WHERE last IS NULL OR i - last > 49 GROUP BY 1)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(stay.text, '')) AS kept_sha256
FROM said s LEFT JOIN gone g ON g.doc_id = s.doc_id LEFT JOIN stay ON stay.doc_id = s.doc_id
""",
    "op13_phrases": r"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
said AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i:i + size - 1] AS p FROM said, (VALUES (1), (2), (3), (4)) s(size) WHERE i + size - 1 <= len(w)) GROUP BY 1, 2 HAVING count(*) >= 30),
found AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM found),
scored AS (SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score FROM cuts c JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, p[i:i + size - 1] AS p, max(a) AS longest FROM (SELECT lang, p, a, size, unnest(range(1, len(p) - size + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS size FROM found)) GROUP BY 1, 2),
stay AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN subs s ON s.lang = b.lang AND s.p = b.p WHERE NOT coalesce(100 * s.longest >= 80 * b.a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay) JOIN totals USING (lang) WHERE rank <= 2000
""",
}
