"""Stores of results and of streams: versions, retention, late rows, the running book."""

from __future__ import annotations

import random
import threading
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettermill.operators import contacts
from lettermill.sources import versions
from lettermill.streaming import jobs, stores

MAIL = "id long, sender_address string, sender_name string, recipients struct<to:array<string>, cc:array<string>, bcc:array<string>>, date timestamp"


def test_501_versions_keep_500(spark, tmp_path):
    root = f"file://{tmp_path}/results"
    for i in range(499):
        place = versions.new_place(root)
        (tmp_path / "results/data" / place.rsplit("/", 1)[1]).mkdir(parents=True)
        versions.publish(root, f"k{i % 7}", str(i), place)
    made = [versions.materialised(spark, root, "k", str(i), lambda i=i: spark.range(i, i + 2), grace_seconds=0) for i in (499, 500)]
    left = versions.entries(root)
    assert len(left) == 500 and [e.version for e in left] == [str(i) for i in range(1, 501)]
    assert versions.lookup(root, "k0", "0") is None and versions.lookup(root, "k1", "1")
    assert len(versions.folder_names(f"{root}/data")) == 500
    assert [sorted(r["id"] for r in m.collect()) for m in made] == [[499, 500], [500, 501]]
    calls: list[int] = []
    again = versions.materialised(spark, root, "k", "499", lambda: calls.append(1) or spark.range(9))
    assert again.count() == 2 and not calls
    assert versions.materialised(spark, root, "k", "0", lambda: spark.range(0)).count() == 0


def test_readers_see_whole_versions_during_the_switch(spark, tmp_path):
    """A reader that looks again and again meets no half-written version, and finishes one that expires under it."""
    root, seen, stop = f"file://{tmp_path}/results", Counter(), threading.Event()

    def read():
        while not stop.is_set():
            if found := versions.entries(root):
                rows = [r["id"] for r in spark.read.parquet(found[-1].place).collect()]
                seen[(found[-1].version, tuple(sorted(rows)))] += 1
            time.sleep(0.01)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(12):
            versions.materialised(spark, root, "k", str(i), lambda i=i: spark.range(i, i + 20, numPartitions=4), keep=2)
    finally:
        time.sleep(0.5)
        stop.set()
        reader.join(60)
    assert len(seen) > 2 and all(rows == tuple(range(int(v), int(v) + 20)) for v, rows in seen)
    assert [e.version for e in versions.entries(root)] == ["10", "11"] and len(versions.folder_names(f"{root}/data")) == 12
    assert versions.expire(root, keep=2, grace_seconds=0) == 0 and len(versions.folder_names(f"{root}/data")) == 2


def test_a_job_that_dies_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/results"

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        versions.materialised(spark, root, "k", "1", fail)
    assert versions.entries(root) == [] and versions.materialised(spark, root, "k", "1", lambda: spark.range(3)).count() == 3


def arrivals(seed: int):
    """Six arrivals over days; some rows come long after their window, some have no stamp, some repeat."""
    rng, start = random.Random(seed), datetime(2025, 1, 1)
    parts: list[list[tuple]] = [[] for _ in range(6)]
    for i in range(600):
        day = rng.randrange(6)
        at = None if rng.random() < 0.03 else start + timedelta(days=day, seconds=rng.randrange(86_400))
        parts[min(5, day + (rng.randrange(4) if rng.random() < 0.2 else 0))].append((i % 550, at, rng.choice("xyz")))
    return parts


@pytest.mark.parametrize("seed", [1, 2])
def test_counted_and_late_rows_are_the_input(spark, tmp_path, seed):
    schema, path = "v long, ts timestamp, kind string", f"file://{tmp_path}/store"
    parts, before, counts, late = arrivals(seed), None, Counter(), []
    for part in parts:
        for v, at, kind in part:
            end = at and at.replace(minute=0, second=0) + timedelta(hours=1)
            if at is None or (before and end <= before - timedelta(minutes=10)):
                late.append((v, at, kind))
            else:
                counts[end, kind] += 1
        before = max([before or datetime.min, *(at for _, at, _ in part if at)])
    for part in parts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        rows = jobs.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        jobs.each_batch(rows, stores.count_buckets(path, key="kind"), f"{tmp_path}/cp").awaitTermination(120)
    check = lambda: (
        {(r["window_end"], r["kind"]): r["n"] for r in stores.counted_buckets(spark, path).collect()} == dict(counts)
        and Counter(tuple(r) for r in stores.late_rows(spark, path).select("v", "ts", "kind").collect()) == Counter(late)
    )
    assert check() and sum(counts.values()) + len(late) == 600 and sum(at is not None for _, at, _ in late) > 20
    stores.count_buckets(path, key="kind")(spark.createDataFrame(parts[3], schema), 3)  # a batch that runs again counts once
    assert check()
    closed = {r["window_end"]: r["closed"] for r in stores.counted_buckets(spark, path).collect()}
    assert all(c == (end <= before - timedelta(minutes=10)) for end, c in closed.items())


def test_running_book_equals_full_build_after_every_batch(spark, tmp_path):
    rng, path = random.Random(7), f"file://{tmp_path}/book"
    people = [f"u{i}@d{i % 3}.example" for i in range(40)]
    me = spark.createDataFrame([(p,) for p in people[:4]] + [(" U1@D1.example ",)], "address string")
    mail = lambda i: (i, rng.choice([*people, " U9@d0.example", "", None]), rng.choice(["Ann", "Bo", "", None]), (rng.sample(people, 2), rng.choice([None, [people[5].upper()]]), []), rng.choice([None, datetime(2025, 1, 1) + timedelta(days=rng.randrange(400))]))
    parts = [[mail(1000 * k + i) for i in range(60)] for k in range(4)]
    columns = ("address", "name", "name_variants", "is_user", "first_seen", "last_seen", "messages_from", "messages_to")
    rows = lambda t: sorted((tuple(r) for r in t.select(*columns).collect()), key=str)
    book = lambda: rows(jobs.book_of_statistics(stores.running_statistics(spark, path), me))
    done: list[tuple] = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, MAIL).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], MAIL).schema)
        jobs.each_batch(stream, stores.upsert_statistics(path, me, buckets=5), f"{tmp_path}/cp").awaitTermination(120)
        done += part
        want = rows(contacts.address_book(spark.createDataFrame(done, MAIL), me))
        assert book() == want
        stores.upsert_statistics(path, me, buckets=5)(spark.createDataFrame(part, MAIL), k)  # the batch runs again
        assert book() == want
    assert len(versions.get_notes(path)) == 2
    one = spark.createDataFrame([(9, "solo@x.y", "S", None, None)], MAIL)
    stores.upsert_statistics(path, me, buckets=5)(one, 4)
    changed = versions.get_notes(path)
    assert sum(changed[4][k] == 4 for k in changed[4]) == 1 and stores.running_statistics(spark, path).filter(F.col("address") == "solo@x.y").count() == 1
