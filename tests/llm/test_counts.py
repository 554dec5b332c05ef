"""Vectors summed over many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lettermill.llm import counts


def adder():
    """A function that tasks get by value."""

    def add(total, values):
        for v in values:
            total[v % len(total)] += 1

    return add


def test_no_group_meets_all_tasks(spark):
    """300 tasks in groups of 8: three levels, each of at most 8 parts a group."""
    rows = spark.range(0, 3000, numPartitions=300)
    parts = counts.partial_sums(rows, adder(), (50,), np.int64, 2).cache()
    assert parts.select("lot").distinct().count() == 300
    for fan, left in ((8, 38), (8, 5), (None, 1)):
        most = parts.groupBy("chunk", *([F.expr(f"lot div {fan}")] if fan else [])).count().agg(F.max("count")).first()[0]
        assert most <= 8
        parts = counts.merged(parts, (50,), np.int64, 2, fan).cache()
        assert parts.groupBy("chunk").count().agg(F.max("count")).first()[0] == left
    vector, n = counts.summed(rows, adder(), (50,), np.int64)
    assert n == 3000 and vector.tolist() == [60] * 50


def test_no_rows_and_wide_rows(spark):
    vector, n = counts.summed(spark.range(0), adder(), (50,), np.int64)
    assert n == 0 and not vector.any()
    wide = lambda total, values: np.add.at(total, np.array(values) % 3, 1.5)
    vector, n = counts.summed(spark.range(30, numPartitions=7), wide, (3, 4), float)
    assert n == 30 and vector.tolist() == [[15.0] * 4] * 3
