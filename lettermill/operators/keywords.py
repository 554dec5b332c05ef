"""Keyword search over a stored trigram index: a query reads one posting list and the texts that it names, not every text.

The index is three Parquet tables in a folder:

* ``postings``: for each trigram of code points, lists of the ids that hold it, a list for each field and block of ``block_rows``
  ids, so no list grows with the archive. The rows lie in partitions by a hash of the trigram, ordered by it within their files, so
  a lookup reads one partition and, by their least and largest trigrams, few of its row groups.
* ``counts``: how many texts hold each trigram, laid out the same way.
* ``texts``: the texts in folders by field and block, from block ``FOLDERS`` on by ranges of blocks that double with the ids, so
  the folders grow with the logarithm of the ids; the ``block`` of a folder is its first one.

A trigram is one number: three code points of 21 bits each. The end of a text counts as two zeros, so a character that stands
anywhere also begins a trigram, and terms of one or two characters are a range of trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.predicates import holds

_LISTS = pa.schema([("gram", pa.int64()), ("field", pa.string()), ("block", pa.int64()), ("ids", pa.list_(pa.int64()))])
_LISTS_DDL = "gram long, field string, block long, ids array<long>"
#: Up to so many candidates are looked up by their ids; more are joined.
DIRECT = 1000
#: So many blocks have a folder each; half as many folders hold each doubling of the blocks.
FOLDERS = 128
#: A task writes the texts of so many blocks of a folder.
FILE_BLOCKS = 64
#: A task makes the posting lists of so many bytes of texts at a time.
PIECE = 1 << 21


def trigrams(text: str, end: bool = True) -> np.ndarray:
    """The distinct trigrams of a text, with those that its end is part of."""
    points = np.frombuffer((text + "\0\0" * end).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def _folder(block: Column) -> Column:
    """The first block of the folder that holds the texts of a block."""
    far = F.abs(block)
    width = F.pow(F.lit(2), F.length(F.bin(far)) - (FOLDERS.bit_length() - 1)).cast("long")
    return F.when(far < FOLDERS, block).otherwise(F.signum(block).cast("long") * (far - F.pmod(far, width)))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECE`` bytes of texts, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _lists(texts: DataFrame, block_rows: int) -> DataFrame:
    """The posting lists of each batch of (field, id, lower-cased text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                fields, said = batch.column(0).dictionary_encode(), batch.column(2).dictionary_encode()
                made = [trigrams(t.as_py()) for t in said.dictionary]  # of equal texts once
                ids, field, code = batch.column(1).to_numpy(), fields.indices.to_numpy(), said.indices.to_numpy()
                order = np.lexsort((ids, field))
                ids, field, code = ids[order], field[order], code[order]
                gram = np.concatenate([made[c] for c in code])
                if not len(gram):
                    continue
                row = np.repeat(np.arange(len(ids)), np.array([len(g) for g in made])[code])
                order = np.argsort(gram, kind="stable")
                gram, row = gram[order], row[order]
                field, ids = field[row], ids[row]
                block = ids // block_rows
                first = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(field) != 0) | (np.diff(block) != 0)]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(gram[first]), fields.dictionary.take(pa.array(field[first])), pa.array(block[first]), lists], schema=_LISTS)

    return texts.mapInArrow(run, _LISTS_DDL)


def index_texts(texts: DataFrame, path: str, *, block_rows: int = 4096, buckets: int = 64) -> None:
    """Adds texts (field, id, text) to the index at ``path``, which is made if need be.

    Several calls, as one for each import, add up; ``block_rows`` and ``buckets`` must stay the same. Null ids and texts are not
    indexed. A text indexed again under its field and id is another text of it, and either is found. Other columns are not read.
    """
    rows = texts.filter("id is not null and text is not null and field is not null").select("field", F.col("id").cast("long").alias("id"), "text")
    block = F.floor(F.col("id") / block_rows).cast("long")
    laid = rows.withColumn("block", _folder(block)).repartition("field", "block", F.floor(block / FILE_BLOCKS)).sortWithinPartitions("field", "block", "id")
    laid.write.mode("append").partitionBy("field", "block").parquet(f"{path}/texts")
    lists = _lists(rows.select("field", "id", F.lower("text").alias("text")), block_rows).groupBy("gram", "field", "block")
    lists = lists.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).withColumn("bucket", _bucket(buckets))  # one block's ids
    dealt = lists.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "gram", "field", "block")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def _rarest(spark: SparkSession, path: str, grams: list[int], buckets: int) -> int | None:
    """Of a term's trigrams the one in the fewest texts; None if one of them is in none."""
    found = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams) & F.col("bucket").isin(_buckets_of(spark, grams, buckets)))
    counts = {r["gram"]: r["n"] for r in found.select("gram", "n").collect()}  # a row a trigram of the term
    return min(grams, key=lambda g: (counts[g], g)) if len(counts) == len(grams) else None


def _buckets_of(spark: SparkSession, grams: list[int], buckets: int) -> list[int]:
    rows = spark.createDataFrame([(g,) for g in grams], "gram long").select(_bucket(buckets).alias("b")).distinct().collect()
    return [r["b"] for r in rows]


def candidates(spark: SparkSession, path: str, term: str, *, buckets: int = 64) -> DataFrame:
    """(field, block, id): the texts that may hold the term, those of its rarest trigram; of a term of one or two characters those of
    every trigram that begins with it. ``block`` names the folder of the text.
    """
    low = term.lower()
    postings = spark.read.parquet(f"{path}/postings")
    if len(low) >= 3:
        gram = _rarest(spark, path, trigrams(low, end=False).tolist(), buckets)
        if gram is None:
            return _named(postings.limit(0))
        chosen = postings.filter((F.col("bucket") == _buckets_of(spark, [gram], buckets)[0]) & (F.col("gram") == gram))
        return _named(chosen)
    start = sum(ord(c) << shift for c, shift in zip(low, (42, 21)))
    chosen = postings.filter((F.col("gram") >= start) & (F.col("gram") < start + (1 << (42 if len(low) == 1 else 21))))
    return _named(chosen)


def _named(postings: DataFrame) -> DataFrame:
    return postings.select("field", _folder(F.col("block")).alias("block"), F.explode("ids").alias("id")).distinct()


def keyword_search(spark: SparkSession, path: str, term: str, *, buckets: int = 64) -> DataFrame:
    """(field, id) of the indexed texts that hold ``term``, without regard to case: the rows that ``holds`` finds in all texts.

    Only blocks with a candidate are read: by their names and ids where they are few, else by a join on (field, block, id), which
    Spark prunes at run time. Of a term of up to three characters the postings say all, and no text is read; with a zero among them
    they cannot tell it from the end of a text. An empty term is in every text.
    """
    if 0 < len(term.lower()) <= 3 and "\0" not in term:
        return candidates(spark, path, term, buckets=buckets).select("field", "id").distinct()
    texts = spark.read.parquet(f"{path}/texts")
    if not term:
        return texts.select("field", "id").distinct()
    found = candidates(spark, path, term, buckets=buckets)
    few = found.limit(DIRECT + 1).collect()
    if len(few) <= DIRECT:
        places = sorted({(r["field"], r["block"]) for r in few})
        named = F.col("field").isin(sorted({f for f, _ in places})) & F.col("block").isin([b for _, b in places]) & F.col("id").isin(sorted({r["id"] for r in few}))
        rows = texts.filter(named) if few else texts.limit(0)
    else:
        rows = texts.join(found, ["field", "block", "id"], "left_semi")
    return rows.filter(holds(F.col("text"), term)).select("field", "id").distinct()
