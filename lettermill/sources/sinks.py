"""Exports: CSV, JSON and Markdown lines, partitioned text mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown_lines(rows: DataFrame, title: str, *fields: str) -> DataFrame:
    """value: '- **title** — field: value; ...' for each row; null fields are left out."""
    shown = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields)))
    return rows.select(F.concat(F.lit("- **"), F.coalesce(F.col(title).cast("string"), F.lit("untitled")), F.lit("**"), F.when(F.size(shown) > 0, F.concat(F.lit(" — "), F.array_join(shown, "; "))).otherwise("")).alias("value"))


def write_markdown(rows: DataFrame, path: str, title: str, *fields: str) -> None:
    markdown_lines(rows, title, *fields).write.mode("overwrite").text(path)


def write_mirror(contents: DataFrame, path: str, key: str = "sha256", text: str = "markdown") -> None:
    """Extracted texts in partitions by the first two characters of their content key."""
    contents.filter("status = 'extracted'").select(F.substring(key, 1, 2).alias("prefix"), key, text).write.mode("overwrite").partitionBy("prefix").parquet(path)
