"""Incremental forms of the archive jobs as Structured Streaming queries; each equals its batch job on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lettermill.operators.contacts import address_statistics, book_of_statistics  # noqa: F401 (a stream takes them as they are)
from lettermill.operators.events import MERGE_DAYS


def read_files(spark: SparkSession, path: str, schema: StructType, *, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder, each once across restarts of the same checkpoint."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def run_available(rows: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Works off what is there and stops; a later run takes up the rest."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(rows: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.outputMode(mode).foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each_id(rows: DataFrame, *, stamp: str = "created_at", delay: str = "7 days") -> DataFrame:
    """One row a message id among rows that come within ``delay`` of each other; state older than that is dropped."""
    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["message_id"])


def store_new(path: str) -> Callable[[DataFrame, int], None]:
    """For each_batch: appends the messages whose id the table at ``path`` lacks, whatever the gap. A repeated batch adds nothing."""

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["message_id"])
        try:
            rows = rows.join(spark.read.schema(batch.schema).parquet(path).select("message_id"), "message_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # else this is the first batch
                raise
        rows.write.mode("append").parquet(path)

    return job


def least_late_rows(query: StreamingQuery) -> int:
    """A lower bound of the rows that the watermark has kept out of the query's state, from the progress reports that it still holds.

    Spark counts behind the partial aggregation: late rows of one key in one task are one. ``stores.count_buckets`` has each row.
    """
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def bucket_counts(rows: DataFrame, *, stamp: str = "ts", size: str = "1 hour", delay: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Counts of tumbling windows; a window closes once the watermark has passed it, later rows are dropped."""
    keys = [F.window(stamp, size)] + ([F.col(key)] if key else [])
    return rows.withWatermark(stamp, delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def throughput(rows: DataFrame, *, stamp: str = "ts", size: str = "30 minutes", slide: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    windows = rows.withWatermark(stamp, delay).groupBy(F.window(stamp, size, slide)).agg(F.count(F.lit(1)).alias("done"))
    minutes = (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")) / 60
    return windows.withColumn("rate", F.col("done") / minutes)


def spike_sessions(spikes: DataFrame, *, stamp: str = "day", delay: str = "1 day") -> DataFrame:
    """Spike days of a series (series, day, cnt) up to three days apart, merged."""
    gap = f"{MERGE_DAYS} days 1 second"
    sessions = spikes.withWatermark(stamp, delay).groupBy("series", F.session_window(stamp, gap)).agg(F.min(stamp).alias("first_spike"), F.max(stamp).alias("last_spike"), F.sum("cnt").alias("spike_total"))
    return sessions.drop("session_window")


ALARM = "thread_id string, message_id string, waiting_since timestamp"


def unanswered_alarms(rows: DataFrame, *, days: int = 3, delay: str = "0 seconds") -> DataFrame:
    """An alarm for each thread whose last inbound message had no answer by the owner for ``days`` of event time.

    ``rows`` has thread_id, message_id, date, mine (sent by the owner). State is the waiting message of a thread, one row.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            waiting, since = state.get
            state.remove()
            yield pd.DataFrame({"thread_id": [key[0]], "message_id": [waiting], "waiting_since": [pd.Timestamp(since, unit="ms")]})
            return
        held = list(state.get) if state.exists else None
        for pdf in batches:
            for r in pdf.sort_values(["date", "message_id"]).itertuples():
                at = int(r.date.timestamp() * 1000)
                if not r.mine and (held is None or at >= held[1]):
                    held = [r.message_id, at]
                elif r.mine and held is not None and at > held[1]:
                    held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(held))
            due = held[1] + days * 86_400_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("date", delay).groupBy("thread_id").applyInPandasWithState(watch, ALARM, "message_id string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def assigned_topics(rows: DataFrame, centroids: DataFrame, *, key: str = "id") -> DataFrame:
    """New messages with their nearest centroid; the centroids are a bounded static table."""
    from lettermill.operators.topics import assign

    return assign(rows, centroids, key=key)
