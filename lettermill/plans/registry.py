"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.sources import archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, over: str = "archive") -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` follows the archive views, or stands alone with ``over='tables'``.

    SQL that begins with a comma adds further common table expressions.
    """

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = archive.SQL + sql if over == "archive" else sql
        return f

    return put


def ts(c: str | Column) -> Column:
    """A timestamp as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")
