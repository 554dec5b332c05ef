"""Bursts, extracted events, evidence, versions, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days that join spikes, days round a window, and the least threshold (fixed values).
MERGE_DAYS, PAD_DAYS, MIN_THRESHOLD = 3, 1, 5.0
#: Allowed values (fixed values).
EVENT_TYPES = ("decision", "meeting", "travel", "purchase", "deadline", "transition", "document", "communication", "user_defined")
PRECISIONS = ("day", "week", "month")
CLAIM_STATUSES = ("direct", "supported")


def day_counts(rows: DataFrame, series: str, date: str = "date") -> DataFrame:
    return rows.filter(F.col(date).isNotNull()).groupBy(F.col(series).alias("series"), F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("cnt"))


def bursts(days: DataFrame, *, max_bursts: int = 20) -> DataFrame:
    """series, burst_start, burst_end, total, rank: the days far above their series' usual volume (series, day, cnt).

    A spike reaches the mean plus two population deviations of the days with messages, or, where these are all alike, twice the
    mean and at least 5. Spikes up to three days apart merge, windows are padded by a day, totals count the padded window, and
    neighbours may share days.
    """
    some = days.filter("cnt > 0").groupBy("series", "day").agg(F.sum("cnt").alias("cnt"))
    usual = some.groupBy("series").agg(F.avg("cnt").alias("m"), F.stddev_pop("cnt").alias("s"))
    edge = F.when(F.col("s") < 1e-12, F.greatest(F.col("m") * 2, F.lit(MIN_THRESHOLD))).otherwise(F.col("m") + 2 * F.col("s"))
    spikes = some.join(usual, "series").filter(F.col("cnt") >= edge).select("series", "day")
    order = Window.partitionBy("series").orderBy("day")
    new = F.coalesce((F.datediff("day", F.lag("day").over(order)) > MERGE_DAYS).cast("int"), F.lit(1))
    islands = spikes.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    windows = islands.groupBy("series", "island").agg(F.date_sub(F.min("day"), PAD_DAYS).alias("burst_start"), F.date_add(F.max("day"), PAD_DAYS).alias("burst_end"))
    inside = windows.withColumn("day", F.explode(F.sequence("burst_start", "burst_end"))).join(some, ["series", "day"], "left")
    totals = inside.groupBy("series", "burst_start", "burst_end").agg(F.sum("cnt").alias("total"))
    best = Window.partitionBy("series").orderBy(F.desc("total"), "burst_start")
    return totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_bursts)


def burst_sources(found: DataFrame, rows: DataFrame, series: str, *, key: str = "id", date: str = "date", top: int = 10) -> DataFrame:
    """The first ``top`` messages of each burst, by date and key: an equi-join on series and day."""
    days = found.select("series", "burst_start", "burst_end", F.explode(F.sequence("burst_start", "burst_end")).alias("day"))
    hits = rows.select(F.col(series).alias("series"), F.col(key).alias("id"), F.col(date).alias("at"), F.to_date(date).alias("day")).join(days, ["series", "day"])
    order = Window.partitionBy("series", "burst_start").orderBy("at", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("series", "burst_start", "id", "rank")


EXTRACTED = "array<struct<title:string,event_type:string,date:string,date_precision:string,summary:string,claims:array<struct<text:string,status:string,source_markers:array<string>>>>>"


def parse_extracted(outputs: DataFrame, sources: DataFrame, *, max_events: int = 2) -> DataFrame:
    """Events of model outputs (output_id, content JSON, window_start, window_end) with cited claims only.

    ``sources`` (output_id, marker, source_id) resolves markers. Fields outside the schema are ignored; titles must not be
    blank, types, precisions and statuses are checked, dates are clamped to the window; claims without a resolved citation go,
    and events without a claim. Malformed content gives no rows.
    """
    content = F.when(F.trim("content").startswith("{"), F.concat(F.lit("["), "content", F.lit("]"))).otherwise(F.col("content"))
    rows = outputs.select("output_id", "window_start", "window_end", F.posexplode(F.from_json(content, EXTRACTED)).alias("pos", "e"))
    day = F.try_to_timestamp(F.col("e.date"), F.lit("yyyy-MM-dd")).cast("date")
    clamped = F.greatest(F.least(day, "window_end"), "window_start")
    good = rows.select(
        "output_id", "pos", F.trim("e.title").alias("title"), F.col("e.event_type").alias("event_type"), F.when(day.isNotNull(), clamped).alias("date"),
        F.coalesce("e.date_precision", F.lit("day")).alias("date_precision"), F.nullif(F.trim("e.summary"), F.lit("")).alias("summary"), F.col("e.claims").alias("claims"),
    ).filter((F.col("title") != "") & F.col("event_type").isin(*EVENT_TYPES) & F.col("date").isNotNull() & F.col("date_precision").isin(*PRECISIONS))
    claims = good.select("output_id", "pos", F.posexplode("claims").alias("at", "c")).select("output_id", "pos", "at", F.trim("c.text").alias("text"), F.coalesce("c.status", F.lit("direct")).alias("status"), F.explode(F.array_distinct("c.source_markers")).alias("marker"))
    cited = claims.filter((F.col("text") != "") & F.col("status").isin(*CLAIM_STATUSES)).join(sources, ["output_id", "marker"])
    per_claim = cited.groupBy("output_id", "pos", "at", "text", "status").agg(F.array_sort(F.collect_set("source_id")).alias("citations"))
    per_event = per_claim.groupBy("output_id", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "text", "status", "citations"))).alias("claims"))
    out = good.drop("claims").join(per_event, ["output_id", "pos"])
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("output_id").orderBy("pos"))).filter(F.col("n") <= max_events).drop("n")
    return out.withColumn("evidence_strength", evidence_strength(F.transform("claims", lambda c: F.size(c["citations"]))))


def evidence_strength(citations: Column) -> Column:
    """Of the citation counts of an event's claims: all at least 2 high, all at least 1 medium, else low."""
    least = F.array_min(citations)
    return F.when(least >= 2, "high").when(least >= 1, "medium").otherwise("low")


def markers(text: str | Column) -> Column:
    """Citation markers like [S1], once each in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1)))


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, pos, marker, source_id (null where nothing matches)."""
    said = answers.select("answer_id", F.posexplode(markers("text")).alias("pos", "marker"))
    return said.join(sources.select("answer_id", "marker", "source_id"), ["answer_id", "marker"], "left")


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """event_id, position of the claims in conflict: their status says so, or a source is cited by direct and conflicting claims alike."""
    cited = claims.select("event_id", "position", "status", F.explode("citations").alias("c")).select("event_id", "position", "status", F.col("c.source_id").alias("source_id"))
    both = cited.groupBy("event_id", "source_id").agg(F.collect_set("status").alias("s")).filter(F.array_contains("s", "direct") & F.array_contains("s", "conflicting")).select("event_id", "source_id")
    torn = cited.join(both, ["event_id", "source_id"], "left_semi").select("event_id", "position")
    return torn.union(claims.filter("status = 'conflicting'").select("event_id", "position")).distinct()


def title_key(title: Column | str) -> Column:
    """The title trimmed, in lower case, with single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(title, r"^\s+|\s+$", ""), r"\s+", " "))


def mark_position(start: Column, precision: Column) -> Column:
    """Where an event's mark stands: its hour where that is known, else the beginning of its day."""
    return F.when(precision == "hour", start).otherwise(F.date_trunc("day", start))


def upsert(events: DataFrame, versions: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, versions, outcome) after automatic events are stored without clobbering reviewed ones.

    ``extracted`` has new_id, scope_fingerprint, title, date, burst_start, burst_end, event_type, evidence_strength, summary. An
    automatic event of the same scope and normalised title whose time lies in the burst window is the same event (the newest by
    time and id): unreviewed, it is superseded by a new current version; reviewed, the version is a suggestion only. Others
    are created.
    """
    old = events.filter("origin = 'automatic'").select("id", "scope_fingerprint", title_key("title").alias("k"), "time_start", F.coalesce("time_end", "time_start").alias("until"), "status")
    new = extracted.withColumn("k", title_key("title"))
    over = (F.to_date("time_start") <= F.col("burst_end")) & (F.to_date("until") >= F.col("burst_start"))
    found = new.join(old, ["scope_fingerprint", "k"]).filter(over).groupBy("new_id").agg(F.max_by(F.struct("id", "status"), F.struct("time_start", "id")).alias("old"))
    placed = new.join(found, "new_id", "left").select(*[c for c in new.columns if c != "k"], F.col("old.id").alias("old_id"), F.col("old.status").alias("old_status"))
    outcome = placed.withColumn("outcome", F.when(F.col("old_id").isNull(), "created").when(F.col("old_status") == "unreviewed", "superseded").otherwise("suggested")).withColumn("event_id", F.coalesce("old_id", "new_id"))
    last = versions.groupBy("event_id").agg(F.max("version").alias("last"))
    order = Window.partitionBy("event_id").orderBy("new_id")
    numbered = outcome.join(last, "event_id", "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    more = numbered.select("event_id", "version", F.lit("automatic").alias("author"), "title", "summary")
    current = numbered.filter("outcome = 'superseded'").groupBy(F.col("event_id").alias("id")).agg(F.max("version").alias("v"))
    kept = events.join(current, "id", "left").withColumn("current_version", F.coalesce("v", "current_version")).drop("v")
    created = numbered.filter("outcome = 'created'").select(F.col("event_id").alias("id"), "title", F.col("date").cast("timestamp").alias("time_start"), F.lit("automatic").alias("origin"), "event_type", F.lit("unreviewed").alias("status"), "evidence_strength", "scope_fingerprint", F.lit(1).alias("current_version"))
    return kept.unionByName(created, allowMissingColumns=True), versions.unionByName(more, allowMissingColumns=True), numbered.select("new_id", "event_id", "version", "outcome")


def full_events(events: DataFrame, versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Each event with its current version, claims and whether a later version is only suggested."""
    last = versions.groupBy("event_id").agg(F.max("version").alias("last"))
    now = versions.select(F.col("event_id").alias("id"), F.col("version").alias("current_version"), F.col("title").alias("version_title"), "summary")
    said = claims.groupBy(F.col("event_id").alias("id"), F.col("version").alias("current_version")).agg(F.array_sort(F.collect_list(F.struct("position", "text", "status"))).alias("claims"))
    rows = events.join(now, ["id", "current_version"], "left").join(said, ["id", "current_version"], "left").join(last, events.id == last.event_id, "left")
    return rows.withColumn("has_suggestions", F.coalesce(F.col("last") > F.col("current_version"), F.lit(False))).drop("event_id", "last")


def overlaps(start: str, end: str, frm: Column, to: Column) -> Column:
    """Interval [start, coalesce(end, start)] meets the viewport [frm, to)."""
    return (F.col(start) < to) & (F.coalesce(F.col(end), F.col(start)) >= frm)


def in_viewport(events: DataFrame, frm: str, to: str, *, after: tuple[str, str] | None = None, limit: int = 500) -> DataFrame:
    """Events that are not dismissed and meet the viewport, ordered by (time_start, id), after a cursor; one row more than ``limit`` tells that more follow."""
    rows = events.filter("status <> 'dismissed'").filter(overlaps("time_start", "time_end", F.lit(frm).cast("timestamp"), F.lit(to).cast("timestamp")))
    if after is not None:
        rows = rows.filter(F.struct("time_start", "id") > F.struct(F.lit(after[0]).cast("timestamp").alias("time_start"), F.lit(after[1]).alias("id")))
    return rows.orderBy("time_start", "id").limit(limit + 1)


def transitions(events: DataFrame, changes: DataFrame) -> DataFrame:
    """event_id, target, verdict ('accepted', 'conflict', 'rejected', 'missing') of requested changes (event_id, target, expected_version)."""
    rows = changes.join(events.select(F.col("id").alias("event_id"), "status", "current_version"), "event_id", "left")
    s = F.col("status")
    allowed = (
        F.when(F.col("target") == "confirmed", ~s.isin("dismissed", "superseded"))
        .when(F.col("target") == "dismissed", s != "superseded")
        .when(F.col("target") == "unreviewed", s == "dismissed")
        .otherwise(F.col("target") == "edited")
    )
    stale = F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("current_version"))
    return rows.select("event_id", "target", F.when(s.isNull(), "missing").when(stale, "conflict").when(allowed, "accepted").otherwise("rejected").alias("verdict"))


def manifest(pins: DataFrame, citations: DataFrame, metadata: DataFrame) -> DataFrame:
    """source_id, title, excerpt_hash: each source once, in order of its first use; metadata fills in, the first known hash counts.

    ``pins`` and ``citations`` have source_id, position, excerpt_hash.
    """
    used = pins.select("source_id", "position", "excerpt_hash", F.lit(0).alias("kind")).unionByName(citations.select("source_id", "position", "excerpt_hash", F.lit(1).alias("kind")))
    first = used.groupBy("source_id").agg(F.min(F.struct("kind", "position")).alias("at"), F.min_by("excerpt_hash", F.when(F.col("excerpt_hash").isNotNull(), F.struct("kind", "position"))).alias("excerpt_hash"))
    return first.join(metadata.select("source_id", "title"), "source_id", "left").select("source_id", "title", "excerpt_hash", "at")


def scope_fingerprint(scope: dict) -> str:
    """``qs_`` and 16 hex digits of the scope's canonical JSON: keys in order, null fields left out, no spaces."""
    text = json.dumps({k: v for k, v in scope.items() if v is not None}, sort_keys=True, separators=(",", ":"))
    return "qs_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a fingerprint of the rows, whatever their order. Sums of two 64-bit hashes of each row, so nothing is gathered; two sets
    of rows with the same number and the same two sums have the same fingerprint."""
    row = F.to_json(F.struct(*columns))
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    parts = rows.select(F.xxhash64(row).alias("h1"), F.xxhash64(F.lit(1), row).alias("h2")).agg(F.count(F.lit(1)).cast("string").alias("n"), total(F.col("h1")).alias("s1"), total(F.col("h2")).alias("s2"))
    return parts.select(F.sha2(F.concat_ws("|", "n", "s1", "s2"), 256).alias("fingerprint"))
