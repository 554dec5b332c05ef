"""Joins on keys of which one may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot where it holds more than one in so many rows, so there are never more hot keys than this.
SHARE = 1000


def hot_keys(table: DataFrame, count: str, total: int) -> DataFrame:
    """The rows of ``table`` (a row a key) whose ``count`` of ``total`` rows is large: ``SHARE`` of them at most, whatever the input."""
    return table.filter(F.col(count) * SHARE > total)


def hot_join(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` (a row a key, with the ``count`` of the key's rows among the ``total`` rows).

    Hot keys travel to the rows, which stay where they are; only the rows of the other keys are dealt by key, so no task gets more than
    a small share of all rows for one key. Null keys meet nothing.
    """
    hot = hot_keys(table, count, total)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.filter(F.col(count) * SHARE <= total), key)
    return near.unionByName(far)
