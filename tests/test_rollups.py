"""Partial aggregates of imports against full builds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettermill.operators import contacts, health, messages, rollups, timeline
from lettermill.sources import versions

MAIL = "id long, thread_id string, sender_address string, sender_name string, recipients struct<to:array<string>, cc:array<string>, bcc:array<string>>, date timestamp"
BOOK = ("address", "name", "name_variants", "is_user", "first_seen", "last_seen", "messages_from", "messages_to")


def made(seed: int, n: int, start: int):
    rng = random.Random(seed)
    people = [f"u{i}@d{i % 3}.example" for i in range(30)]
    for i in range(start, start + n):
        at = None if rng.random() < 0.05 else datetime(2023, 12, 1) + timedelta(hours=rng.randrange(24 * 500))
        yield i, rng.choice(["t1", "t2", f"t{i}", None]), rng.choice([*people, None]), rng.choice(["Ann", "Bo", None]), (rng.sample(people, 2), rng.choice([None, [people[3]]]), []), at


@pytest.fixture()
def parts():
    return [list(made(k, 70, 1000 * k)) for k in range(3)]


def test_equal_to_full_builds_after_each_import(spark, tmp_path, parts):
    root, done = f"file://{tmp_path}/rollups", []
    me = spark.createDataFrame([("u1@d1.example",), ("u3@d0.example",), ("u1@d1.example",)], "address string")
    people = spark.range(17)
    for k, part in enumerate(parts):
        done += part
        bridge = spark.createDataFrame([(r[0], f"s{r[0] % 9}") for r in done if r[0] % 2], "email_id long, sha256 string")
        new = spark.createDataFrame(part, MAIL)
        version = f"{health.data_version(new, 'date')}/{rollups.owner_mark(me)}"
        assert rollups.stale(root, {f"imp{k}": version}) == [f"imp{k}"]
        assert rollups.add_import(root, f"imp{k}", version, new, bridge, me) and not rollups.add_import(root, f"imp{k}", version, new, bridge, me)
        mails = spark.createDataFrame(done, MAIL)
        assert rollups.summary(spark, root, people).first() == health.archive_summary(mails, bridge.select("sha256").distinct(), people).first()
        rows = lambda t, *c: sorted((tuple(r) for r in t.select(*c).collect()), key=str)
        assert rows(rollups.address_book(rollups.partials(spark, root, "book"), me), *BOOK) == rows(contacts.address_book(mails, me), *BOOK)
        met = rollups.partials(spark, root, "met")
        for how in ({}, {"direction": "inbound"}, {"direction": "outbound", "after": "2024-02-01"}, {"after": "2024-01-01", "before": "2024-07-01"}):
            assert rows(rollups.top_contacts(met, me, **how), "key", "messages") == rows(messages.top_contacts(mails, me, **how), "key", "messages")
        days = rollups.partials(spark, root, "days")
        for unit in ("day", "week", "month", "year"):
            how = {"unit": unit, "after": "2024-01-01", "before": datetime(2024, 11, 5)}
            assert rows(rollups.lanes(days, **how), "lane", "bucket", "n") == rows(timeline.lanes(mails, bridge, **how), "lane", "bucket", "n")  # so few people that sketches are exact
    assert rollups.stale(root, {"imp0": "x", "imp1": versions.newest(root)["imp1"].version, "imp9": "1"}) == ["imp0", "imp9"]
    again = spark.createDataFrame(parts[0][:5], MAIL)
    rollups.add_import(root, "imp0", "changed", again, bridge, me)
    assert rollups.summary(spark, root, people).first()["messages"] == 145 and len(versions.entries(root)) == 3


def test_reads_only_partials(spark, tmp_path, parts):
    root = f"file://{tmp_path}/rollups"
    spark.createDataFrame(parts[0], MAIL).write.parquet(f"{tmp_path}/mails")
    mails = spark.read.parquet(f"{tmp_path}/mails")
    bridge, me = spark.createDataFrame([], "email_id long, sha256 string"), spark.createDataFrame([("u1@d1.example",)], "address string")
    rollups.add_import(root, "a", "1", mails, bridge, me)
    out = [rollups.summary(spark, root, spark.range(3)), rollups.lanes(rollups.partials(spark, root, "days"), unit="year"), rollups.address_book(rollups.partials(spark, root, "book"), me)]
    assert all("/rollups/" in f for t in out for f in t.inputFiles()) and all(t.inputFiles() for t in out)
    for bad in ({"unit": "hour"}, {"unit": "day", "after": "2024-01-01 10:00:00"}):
        with pytest.raises(ValueError):
            rollups.lanes(rollups.partials(spark, root, "days"), **bad)
    with pytest.raises(ValueError):
        rollups.partials(spark, f"file://{tmp_path}/none", "days")


def test_sketches_of_days_make_those_of_all_rows(spark):
    """120 days of 60,000 senders: the rollup has the registers of one sketch over all rows, and the estimate is within three standard errors."""
    rows = spark.range(240_000).select("id", F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(60_000))).alias("sender_address"), (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id") % 120)).alias("date"))
    days = rollups.day_partials(rows, spark.createDataFrame([], "email_id long, sha256 string"))
    merged = days.agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("n")).first()["n"]
    whole = rows.agg(F.hll_sketch_agg("sender_address", rollups.LG).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first()["n"]
    exact = rows.agg(F.countDistinct("sender_address").alias("n")).first()["n"]
    assert merged == whole and abs(merged - exact) <= 3 * 1.04 / 2 ** (rollups.LG / 2) * exact
    by_month = {r["bucket"]: r["n"] for r in rollups.lanes(days, unit="month").filter("lane = 'people'").collect()}
    for r in timeline.people_lane(rows, "month").collect():
        assert abs(by_month[r["bucket"]] - r["n"]) <= 3 * 1.04 / 2 ** (rollups.LG / 2) * r["n"]
