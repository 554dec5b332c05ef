"""Operator 2, line dedup: lines found in many documents are dropped everywhere. DataFrame functions only.

One pass explodes the lines into hashes (16 bytes and a position, staged once in the shared folder; texts stay where they are).
Distinct documents a hash are counted with partial aggregation, so a line of a third of all documents is a few rows a task. The
lines of hot keys, a bounded number of keys, are marked where they lie; only the others are dealt by key. The positions to drop are
gathered a document, and the texts move once, in the join that applies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.hot import hot_join
from lettermill.staging import staged

#: ASCII white space (fixed value).
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters keep their case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and the ``carry`` columns: lines whose key is in ``min_docs`` documents or more are gone.

    Lines are cut at \\n; keys shorter than ``min_chars`` code points never count. The other lines stay in order, joined by \\n;
    where none stays the text is empty. A null text counts as empty: one empty line. Documents are told apart by doc_id: rows that
    repeat one count as one document, whatever their texts, and each row gives a row with its own lines. Rows with a null doc_id
    count as no document, but lose common lines like any other. Texts of any length are taken whole; a row holds the lines of one
    text. Other columns are not read, so names cannot clash. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), *carry, F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    each = rows.select("doc_id", "text_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    key = line_key(F.col("line"))
    keyed = each.select("doc_id", "text_hash", "n", "at", key.alias("key")).filter(F.char_length("key") >= min_chars)
    hashed = staged(keyed.select("doc_id", "text_hash", "n", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    owners = hashed.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("held"))
    counts = owners.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.sum("held").alias("held"))
    common = staged(counts.filter(F.col("docs") >= min_docs).select("h1", "h2", "held"), "common")
    gone = hot_join(hashed, common, ["h1", "h2"], "held", max(hashed.count(), 1))
    drops = gone.groupBy("doc_id", "text_hash").agg(F.first("n").alias("n"), F.collect_set("at").alias("drop"))
    drops = drops.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "drop").alias("stay"))
    both = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left")
    kept = F.when(F.col("stay").isNull(), F.col("lines")).otherwise(F.transform("stay", lambda i: F.get("lines", i)))
    dropped = F.when(F.col("stay").isNull(), 0).otherwise(F.size("lines") - F.size("stay"))
    return both.select("doc_id", *carry, F.array_join(kept, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
