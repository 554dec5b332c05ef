"""Time-bucket lanes, range comparison and series shares."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.operators.predicates import in_range

#: Seconds of each unit, finest first (fixed values).
UNIT_SECONDS = {"hour": 3600, "day": 86_400, "week": 604_800, "month": 2_629_746, "quarter": 7_889_238, "year": 31_556_952}
MAX_BUCKETS = 2000


def pick_unit(start: datetime, end: datetime, pixels: int, unit: str = "auto") -> str:
    """The finest unit whose buckets fit the width; a given unit of more than 2000 buckets is an error that names the finest valid one."""
    span = max((end - start).total_seconds(), 0)
    if unit != "auto":
        if span / UNIT_SECONDS[unit] > MAX_BUCKETS:
            fits = next((u for u, s in UNIT_SECONDS.items() if span / s <= MAX_BUCKETS), "year")
            raise ValueError(f"{unit} gives more than {MAX_BUCKETS} buckets; the finest valid unit is {fits}")
        return unit
    most = max(pixels / 8, 32)
    return next((u for u, s in UNIT_SECONDS.items() if span / s <= most), "year")


def bucket(unit: str, date: Column | None = None) -> Column:
    return F.date_trunc(unit, F.col("date") if date is None else date)


def message_lane(mails: DataFrame, unit: str) -> DataFrame:
    return mails.filter("date is not null").groupBy(bucket(unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def attachment_lane(mails: DataFrame, bridge: DataFrame, unit: str) -> DataFrame:
    rows = bridge.join(mails.select(F.col("id").alias("email_id"), "date"), "email_id").filter("date is not null")
    return rows.groupBy(bucket(unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def people_lane(mails: DataFrame, unit: str, *, exact: bool = True) -> DataFrame:
    """Distinct senders a bucket; ``exact=False`` keeps a sketch a bucket instead of the addresses."""
    count = F.countDistinct("sender_address") if exact else F.approx_count_distinct("sender_address", 0.01)
    return mails.filter("date is not null").groupBy(bucket(unit).alias("bucket")).agg(count.alias("n"))


def extent(mails: DataFrame) -> DataFrame:
    return mails.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def lanes(mails: DataFrame, bridge: DataFrame, *, after: Any, before: Any, unit: str) -> DataFrame:
    """lane, bucket, n of the viewport, and the density over the whole extent."""
    seen = mails.filter(in_range(F.col("date"), after, before))
    named = lambda df, name: df.select(F.lit(name).alias("lane"), "bucket", "n")
    return named(message_lane(seen, unit), "messages").unionByName(named(attachment_lane(seen, bridge, unit), "attachments")).unionByName(named(people_lane(seen, unit), "people")).unionByName(named(message_lane(mails, unit), "density"))


def top_series(rows: DataFrame, series: str, unit: str, top: int) -> DataFrame:
    """series, bucket, n of the ``top`` largest series (ties by name)."""
    counts = rows.filter("date is not null").groupBy(series, bucket(unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.filter(F.col(series).isNotNull()).groupBy(series).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), series).limit(top)
    return counts.join(largest.select(series), series, "left_semi")


def compare(mails: DataFrame, a: tuple[Any, Any], b: tuple[Any, Any], unit: str) -> DataFrame:
    """range ('a' or 'b'), bucket, n: both ranges in one pass; a message in both counts in both."""
    tags = F.array_compact(F.array(F.when(in_range(F.col("date"), *a), "a"), F.when(in_range(F.col("date"), *b), "b")))
    return mails.select("date", F.explode(tags).alias("range")).groupBy("range", bucket(unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def aligned(a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> bool:
    """Whether two ranges differ by 5 percent of the longer at most."""
    x, y = (a[1] - a[0]).total_seconds(), (b[1] - b[0]).total_seconds()
    return abs(x - y) <= 0.05 * max(x, y)


def previous_range(a: tuple[datetime, datetime]) -> tuple[datetime, datetime]:
    return a[0] - (a[1] - a[0]), a[0]


def around(day: datetime, days: int = 90) -> tuple[datetime, datetime]:
    return day - timedelta(days=days), day + timedelta(days=days)


def shares(series: DataFrame, key: str) -> DataFrame:
    """``share``: each bucket's part of its series' total, 0 where the total is 0."""
    total = F.sum("n").over(Window.partitionBy(key))
    return series.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.col("n") / total))


def percent_change(old: Column, new: Column) -> Column:
    """Null where the base is 0, 0 where both are."""
    return F.when((old == 0) & (new == 0), F.lit(0.0)).when(old == 0, F.lit(None).cast("double")).otherwise((new - old) / old * 100)


def matrix(rows: DataFrame, series: str) -> DataFrame:
    """series, year, n with row, column and grand totals (null stands for all)."""
    return rows.filter("date is not null").select(series, F.year("date").alias("year")).cube(series, "year").agg(F.count(F.lit(1)).alias("n"))
