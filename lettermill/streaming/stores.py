"""Stream sinks that keep their state in tables, so nothing that grows stays in a state store.

A sink is a ``foreachBatch`` job (``jobs.each_batch``). What a batch writes lies under its batch id, and a note, a small file that
is moved into place last, makes it count. A batch that is run again, after a failure or a restart, starts from the notes before its
id and overwrites its own rows, so it counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.contacts import address_statistics
from lettermill.sources.versions import drop_folder, folder_names, get_notes, put_note

Job = Callable[[DataFrame, int], None]
STATISTICS = "address string, name string, messages_from long, messages_to long, first_seen timestamp, last_seen timestamp"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "address", "name").agg(F.sum("messages_from").alias("messages_from"), F.sum("messages_to").alias("messages_to"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_statistics(path: str, me: DataFrame, *, buckets: int = 64, keep: int = 2) -> Job:
    """For each_batch over messages: the figures of ``address_statistics``, upserted by (address, name) into a bucketed table.

    A batch reads and rewrites the buckets of the addresses it meets and no others. A note lists, for each bucket, the batch that
    wrote it last: ``buckets`` numbers. The newest ``keep`` notes and what they name stay, which a repeated batch needs; what is
    older goes. A bucket holds its share of the addresses, however many messages they have.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {i: n for i, n in get_notes(path).items() if i < batch_id}
        latest = dict(before[max(before)]) if before else {}
        fresh = address_statistics(batch, me).withColumn("bucket", F.pmod(F.xxhash64("address"), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        held = [_bucket_rows(spark, path, k, latest[str(k)]) for k in touched if str(k) in latest]
        merged = _merged(reduce(DataFrame.unionByName, held, fresh))
        merged.repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
        fresh.unpersist()
        put_note(path, batch_id, latest | {str(k): batch_id for k in touched})
        _forget(path, keep)

    return job


def _bucket_rows(spark: SparkSession, path: str, bucket: int, batch: int) -> DataFrame:
    return spark.read.schema(STATISTICS).parquet(f"{path}/rows/batch={batch}/bucket={bucket}").withColumn("bucket", F.lit(bucket))


def _forget(path: str, keep: int) -> None:
    notes = get_notes(path)
    newest = sorted(notes)[-keep:]
    named = {f"batch={b}" for i in newest for b in notes[i].values()} | {f"batch={i}" for i in newest}
    for name in folder_names(f"{path}/rows"):
        if name not in named:
            drop_folder(f"{path}/rows/{name}")
    for i in set(notes) - set(newest):
        drop_folder(f"{path}/notes/{i:020d}.json")


def running_statistics(spark: SparkSession, path: str, *, before: int | None = None) -> DataFrame:
    """The statistics after the newest batch, or after the newest one before a batch id; ``jobs.book_of_statistics`` makes the book."""
    notes = {i: n for i, n in get_notes(path).items() if before is None or i < before}
    parts = [_bucket_rows(spark, path, int(k), b) for k, b in notes[max(notes)].items()] if notes else []
    none = spark.createDataFrame([], STATISTICS + ", bucket int")
    return reduce(DataFrame.unionByName, parts, none).drop("bucket")


def count_buckets(path: str, *, stamp: str = "ts", size: str = "1 hour", delay: str = "10 minutes", key: str | None = None) -> Job:
    """For each_batch over raw rows: counts of tumbling windows, and the rows that came too late for theirs, written apart.

    Rows are tagged before they are aggregated: a row is late if its window had ended by the watermark, the largest stamp of all
    batches before less ``delay``. Late rows go whole to ``late`` with the reason and that watermark; rows without a stamp belong to
    no window and go there too. All others are counted, so counted and late rows together are the input, row by row.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        seen = max((n["seen"] for i, n in get_notes(path).items() if i < batch_id and n["seen"] is not None), default=None)
        watermark = (F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {delay}")) if seen is not None else F.lit(None).cast("timestamp")
        at = F.col(stamp).cast("timestamp")
        dated = batch.filter(at.isNotNull()).withColumn("window_end", F.window(at, size)["end"])
        tagged = dated.withColumn("reason", F.when(F.col("window_end") <= watermark, "late")).unionByName(batch.filter(at.isNull()).withColumns({"window_end": F.lit(None).cast("timestamp"), "reason": F.lit("no stamp")}))
        tagged = tagged.persist()
        tagged.filter("reason is not null").withColumn("watermark", watermark).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        keys = ["window_end", *([key] if key else [])]
        tagged.filter("reason is null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        newest = tagged.agg(F.max(F.unix_micros(at)).alias("t")).first()["t"]
        tagged.unpersist()
        put_note(path, batch_id, {"seen": newest})

    return job


def _of_batches(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    paths = [f"{path}/{kind}/batch={i}" for i in sorted(get_notes(path))]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def counted_buckets(spark: SparkSession, path: str, *, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame | None:
    """start, window_end, the key, n, closed: the counts of all batches that have a note; closed windows get no more rows. None before the first."""
    rows = _of_batches(spark, path, "counts")
    if rows is None:
        return None
    seen = max((n["seen"] for n in get_notes(path).values() if n["seen"] is not None), default=None)
    closed: Column = F.lit(False) if seen is None else F.col("window_end") <= F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {delay}")
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).withColumns({"start": F.col("window_end") - F.expr(f"INTERVAL {size}"), "closed": closed})


def late_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that were not counted, with window_end, reason and watermark. None before the first batch."""
    return _of_batches(spark, path, "late")
