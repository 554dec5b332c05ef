"""Pages of a table that is laid out in the order of its pages.

Rows lie in parts by range of (date, key), undated rows apart, sorted within each; the least and largest place and the number of
rows of each part are kept beside them. A page is read from the parts that its cursor and length can touch, two or three, whatever
the size of the table.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lettermill.operators.predicates import keyset_after
from lettermill.staging import staged


#: Rows of a range that one task sorts, where there are more than ``RANGES`` times as many.
RANGE_ROWS, RANGES = 500_000, 32


def lay_out(rows: DataFrame, path: str, *, date: str = "date", key: str = "id", rows_per_part: int = 1_000_000) -> None:
    """Writes ``rows`` to ``path`` in the order of (date, key), ``rows_per_part`` rows a part at most. Rows without a key are left out.

    Rows are dealt in ranges of many parts, so the sample that sets the ranges' ends does not grow with the parts; a range is cut into
    parts by the place of a row in it.
    """
    held = rows.filter(F.col(key).isNotNull()).withColumn("undated", F.col(date).isNull())
    n = held.count()
    ranges = max(1, min(-(-n // rows_per_part), max(RANGES, -(-n // max(RANGE_ROWS, rows_per_part)))))
    laid = held.repartitionByRange(ranges, "undated", date, key).sortWithinPartitions("undated", date, key).withColumn("at", F.monotonically_increasing_id())  # a range's number, then 33 bits of the row's
    part = F.shiftright("at", 33) * ((1 << 31) // ranges) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / rows_per_part)
    laid = staged(laid.withColumn("part", part.cast("int")).drop("at"), "laid")
    place = F.struct(date, key)
    bounds = laid.groupBy("undated", "part").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.select("undated", "part", F.col("low")[date].alias("low_date"), F.col("low")[key].alias("low_key"), F.col("high")[date].alias("high_date"), F.col("high")[key].alias("high_key"), "n")
    bounds.coalesce(1).write.parquet(f"{path}/bounds")  # a row a part
    rows.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    laid.write.partitionBy("undated", "part").parquet(f"{path}/rows")


def _touched(bounds: list, date: datetime | None, key: Any, started: bool, descending: bool, limit: int) -> list[tuple[bool, int]]:
    """The parts, in page order, that can hold the ``limit`` rows after the cursor."""
    order = sorted(bounds, key=lambda b: (b["low_date"] or datetime.min, b["low_key"]), reverse=descending)
    order = sorted(order, key=lambda b: b["undated"])
    out, held = [], 0
    for b in order:
        end = (b["low_date"], b["low_key"]) if descending else (b["high_date"], b["high_key"])
        if started:
            if date is None:
                passed = not b["undated"] or (end[1] >= key if descending else end[1] <= key)
            else:
                passed = not b["undated"] and (end >= (date, key) if descending else end <= (date, key))
            if passed:
                continue
        out.append((b["undated"], b["part"]))
        held += b["n"] if len(out) > 1 or not started else 0  # of the first part any number may lie before the cursor
        if held >= limit:
            break
    return out


def _ahead(bounds: DataFrame, after: tuple[datetime | None, Any] | None, limit: int, descending: bool) -> list:
    """The bounds of the first parts that reach past the cursor, as many as ``limit`` rows can need: each has a row at least."""
    date, key = after or (None, None)
    end = "low" if descending else "high"
    beyond = lambda c, v: c < v if descending else c > v
    if after is not None:
        own = beyond(F.col(f"{end}_key"), F.lit(key))
        later = beyond(F.struct(f"{end}_date", f"{end}_key"), F.struct(F.lit(date).cast(bounds.schema[f"{end}_date"].dataType).alias(f"{end}_date"), F.lit(key).cast(bounds.schema[f"{end}_key"].dataType).alias(f"{end}_key")))
        bounds = bounds.filter(F.col("undated") & own if date is None else F.col("undated") | later)
    turn = F.desc if descending else F.asc
    return bounds.orderBy("undated", turn("low_date"), turn("low_key")).limit(limit + 2).collect()


def page(spark: SparkSession, path: str, *, after: tuple[datetime | None, Any] | None = None, limit: int = 100, descending: bool = False, date: str = "date", key: str = "id") -> DataFrame:
    """The ``limit`` rows after a cursor (date, key), or the first ones, in the order of ``keyset_after``: undated rows last in both directions."""
    parts = _touched(_ahead(spark.read.parquet(f"{path}/bounds"), after, limit, descending), *(after or (None, None)), after is not None, descending, limit)
    rows = spark.read.parquet(f"{path}/columns")
    if parts:  # other parts are not even listed
        laid = spark.read.schema(StructType([*rows.schema.fields, StructField("undated", BooleanType()), StructField("part", IntegerType())])).option("basePath", f"{path}/rows")
        rows = laid.parquet(*(f"{path}/rows/undated={str(u).lower()}/part={p}" for u, p in parts)).filter(F.col("part").isin([p for _, p in parts])).drop("undated", "part")
    if after is not None:
        rows = rows.filter(keyset_after(after[0], after[1], descending=descending, date_col=date, key_col=key))
    order = [F.col(date).desc_nulls_last(), F.col(key).desc()] if descending else [F.col(date).asc_nulls_last(), F.col(key).asc()]
    return rows.orderBy(*order).limit(limit)
