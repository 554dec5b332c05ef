"""Address book and contacts: build, score, search, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.operators.messages import participants
from lettermill.staging import staged

#: Base, weights and patterns of the human-probability score (fixed values).
BASE = 0.50
WEIGHTS = {
    "bidirectional": 0.35,
    "user_initiated": 0.15,
    "personal_name": 0.10,
    "automated_pattern": -0.40,
    "list_pattern": -0.30,
    "one_way_bulk": -0.20,
    "replied_threads": 0.25,
    "shallow_threads": -0.15,
    "deep_threads": 0.10,
    "org_name": -0.20,
}
PERSONAL = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$"
NOT_PERSONAL = r"(?i)\b(list|team|support|noreply|newsletter|admin|mailer|billing|notifications?)\b"
AUTOMATED = r"(?i)(?:no-?reply|donotreply|do-not-reply|notifications?|alerts?|mailer-daemon|postmaster|bounce|newsletters?|marketing|updates|receipts?|billing|invoices?)"
LIST = r"(?i)lists\.|googlegroups\.com|listserv|-announce@|-dev@|-users@"
ORGANISATION = r"(?i)\b(?:noreply|no-reply|do-not-reply|support|team|billing|notifications?|alerts?|info|sales|newsletter|updates?|admin|help|service|marketing|customer care)\b"


def normalised(address: str | Column) -> Column:
    return F.lower(F.trim(address))


def name_key(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]", ""))


def touched_addresses(mails: DataFrame, me: DataFrame) -> DataFrame:
    """Every address that sends or that the owner writes to in these messages."""
    mine = mails.withColumn("sender_address", normalised("sender_address")).join(me.select(normalised("address").alias("sender_address")).distinct(), "sender_address", "left_semi")
    got = participants(mine, "id").select(normalised("recipient_address").alias("address"))
    return mails.select(normalised("sender_address").alias("address")).union(got).filter("address is not null and address <> ''").distinct()


def address_statistics(rows: DataFrame, me: DataFrame, *, only: DataFrame | None = None) -> DataFrame:
    """Figures of each (address, name): messages_from, messages_to, first_seen, last_seen.

    A message counts once for its sender and, where the sender is in ``me`` (address, a static table), once for each address it goes
    to; the messages are read once. Counts, minima and maxima merge, so parts, or the last state of a stream, equal a full build.
    ``only`` (address) limits the addresses; ``book_of_statistics`` makes the book.
    """
    own = me.select(normalised("address").alias("sender_address")).distinct().withColumn("mine", F.lit(True))
    none = F.array().cast("array<string>")
    arms = F.concat(*(F.coalesce(F.col(f"recipients.{a}"), none) for a in ("to", "cc", "bcc")))
    tagged = rows.withColumn("sender_address", normalised("sender_address")).join(own, "sender_address", "left")
    side = lambda address, name, sent: F.struct(address.alias("address"), name.alias("name"), F.lit(sent).alias("sent"))
    sender = F.array(side(F.col("sender_address"), F.nullif("sender_name", F.lit("")), True))
    got = F.transform(F.array_distinct(F.transform(arms, normalised)), lambda a: side(a, F.lit(None).cast("string"), False))
    met = tagged.select("date", F.explode(F.concat(sender, F.when(F.col("mine"), got).otherwise(F.slice(sender, 1, 0)))).alias("m")).select("date", "m.*")
    met = met.filter("address <> ''")
    if only is not None:
        met = met.join(only.select("address").distinct(), "address", "left_semi")
    return met.groupBy("address", "name").agg(F.count_if("sent").alias("messages_from"), F.count_if(~F.col("sent")).alias("messages_to"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


def book_of_statistics(state: DataFrame, me: DataFrame) -> DataFrame:
    """The address book of such figures: address, name, name_variants, is_user, first_seen, last_seen, messages_from, messages_to."""
    own = me.select(normalised("address").alias("address")).distinct().withColumn("u", F.lit(True))
    book = state.groupBy("address").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.struct(-F.col("messages_from"), F.col("name")))).alias("name"), F.array_sort(F.collect_set("name")).alias("name_variants"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("messages_from").alias("messages_from"), F.sum("messages_to").alias("messages_to"),
    )
    return book.join(own, "address", "left").withColumn("is_user", F.col("u").isNotNull()).drop("u")


def address_book(mails: DataFrame, me: DataFrame, *, only: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """address, contact_id, name, name_variants, is_user, first_seen, last_seen, messages_from, messages_to.

    ``messages_to`` counts the owner's messages to an address once each, in whatever arms it stands. ``only`` (address) limits
    the rows, as after an import, with the same figures as a full build; ``existing`` (address, contact_id) keeps its
    contacts, other addresses get one of their own.
    """
    stats = address_statistics(mails, me, only=only)
    out = book_of_statistics(stats, me)
    own_id = F.concat(F.lit("ct_"), F.substring(F.sha2("address", 256), 1, 16))
    if existing is None:
        return out.withColumn("contact_id", own_id)
    return out.join(existing.select("address", F.col("contact_id").alias("kept")), "address", "left").withColumn("contact_id", F.coalesce("kept", own_id)).drop("kept")


def rollup(book: DataFrame) -> DataFrame:
    """One row a contact over its addresses."""
    return book.groupBy("contact_id").agg(
        F.array_sort(F.collect_set("address")).alias("addresses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("name_variants")))).alias("name_variants"),
        F.min_by("address", F.struct(-(F.col("messages_from") + F.col("messages_to")), F.col("address"))).alias("primary_address"),
        F.min_by("name", F.struct(F.col("name").isNull(), -F.col("messages_from"), F.col("address"))).alias("display_name"),
        F.sum("messages_from").alias("messages_from"), F.sum("messages_to").alias("messages_to"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_and("is_user").alias("only_user"),
    )


def human_probability(book: DataFrame, mails: DataFrame, me: DataFrame) -> DataFrame:
    """contact_id, human_probability, signals (map of the weights that counted); contacts that are only the owner have no row."""
    own = me.select(normalised("address").alias("address")).distinct().withColumn("mine", F.lit(1))
    rows = mails.filter("thread_id is not null").groupBy("thread_id", normalised("sender_address").alias("address")).agg(F.count(F.lit(1)).alias("said"))
    sizes = rows.join(own, "address", "left").groupBy("thread_id").agg(F.sum("said").alias("depth"), F.max("mine").alias("replied"))
    per = rows.join(sizes, "thread_id").groupBy("address").agg(F.sum("said").alias("n"), F.sum(F.col("said") * F.col("depth")).alias("depth"), F.sum(F.when(F.col("replied") == 1, F.col("said")).otherwise(0)).alias("replied"))
    threads = per.join(book.select("address", "contact_id"), "address").groupBy("contact_id").agg((F.sum("depth") / F.sum("n")).alias("depth"), (F.sum("replied") / F.sum("n")).alias("ratio"))
    c = rollup(book).filter("not only_user").join(threads, "contact_id", "left")
    some = lambda arr, f: F.exists(arr, f)
    personal = some("name_variants", lambda x: F.trim(x).rlike(PERSONAL) & ~x.rlike(NOT_PERSONAL) & ~x.rlike(r"\d"))
    tests = {
        "bidirectional": (F.col("messages_from") > 0) & (F.col("messages_to") > 0),
        "user_initiated": F.col("messages_to") > 0,
        "personal_name": personal,
        "automated_pattern": some("addresses", lambda x: F.split_part(x, F.lit("@"), F.lit(1)).rlike(AUTOMATED)),
        "list_pattern": some("addresses", lambda x: x.rlike(LIST)),
        "one_way_bulk": (F.col("messages_from") >= 20) & (F.col("messages_to") == 0),
        "replied_threads": F.col("ratio") >= 0.3,
        "shallow_threads": (F.col("depth") < 1.5) & (F.col("messages_from") >= 10),
        "deep_threads": F.col("depth") >= 3.0,
        "org_name": some("name_variants", lambda x: x.rlike(ORGANISATION)),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.when(F.coalesce(t, F.lit(False)), F.lit(WEIGHTS[k])).alias("value")) for k, t in tests.items()))
    signals = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    score = F.aggregate(F.map_values("signals"), F.lit(BASE), lambda s, w: s + w)
    return c.select("contact_id", signals.alias("signals")).select("contact_id", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), score)), 4).alias("human_probability"), "signals")


def search(cards: DataFrame, *, text: str | None = None, kind: str | None = None, tag: str | None = None, min_probability: float | None = None, needs_review: bool = False) -> DataFrame:
    """Cards (rollup with kind, tags, human_probability) that match, with ``rank_key``: volume, or for review volume x probability."""
    rows = cards.filter("not only_user")
    if text:
        low = text.lower()
        hit = lambda c: F.exists(c, lambda x: F.lower(x).contains(low))
        rows = rows.filter(F.coalesce(F.lower("display_name").contains(low), F.lit(False)) | hit("addresses") | hit("name_variants"))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if min_probability is not None:
        rows = rows.filter(F.col("human_probability") >= min_probability)
    volume = F.col("messages_from") + F.col("messages_to")
    if needs_review:
        return rows.filter("kind = 'unknown'").withColumn("rank_key", volume * F.coalesce("human_probability", F.lit(0.5)))
    return rows.withColumn("rank_key", volume.cast("double"))


def _named(book: DataFrame, min_messages: int) -> DataFrame:
    """contact_id, primary_address, n, name_keys, name_key: a row for each name of each contact with enough messages that is not only the owner."""
    cards = rollup(book).filter(f"not only_user and messages_from + messages_to >= {min_messages}")
    keys = F.array_sort(F.array_distinct(F.transform("name_variants", name_key)))
    rows = cards.select("contact_id", "primary_address", (F.col("messages_from") + F.col("messages_to")).alias("n"), F.filter(keys, lambda k: k != "").alias("name_keys"))
    return rows.withColumn("name_key", F.explode("name_keys"))


def merge_groups(book: DataFrame, *, min_messages: int = 2) -> DataFrame:
    """name_key, contact_id, representative, members, volume: the contacts of each name that two or more share.

    The representative is the contact with the most messages, ties by id; ``volume`` adds up its messages and the contact's (its own
    once). As many rows as there are names of contacts, however many share one: the form of ``merge_candidates`` for large archives.
    """
    keyed = _named(book, min_messages)
    groups = keyed.groupBy("name_key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct((-F.col("n")).alias("less"), "contact_id")).alias("top")).filter("members > 1")
    rows = keyed.join(groups, "name_key")
    volume = F.when(F.col("contact_id") == F.col("top.contact_id"), F.col("n")).otherwise(F.col("n") - F.col("top.less"))
    return rows.select("name_key", "contact_id", F.col("top.contact_id").alias("representative"), "members", volume.alias("volume"))


def merge_candidates(book: DataFrame, *, min_messages: int = 2, block: int = 1000) -> DataFrame:
    """id_a, id_b, name_key, volume, address_a, address_b: contacts that share a name, each with enough messages and not only the owner.

    Every pair of a name has a row, so a name that many contacts share has many; ``merge_groups`` has a row a contact. A name's
    contacts, in the order of their primary addresses, are cut into blocks of half of ``block``, which travel as one row each; four
    neighbours meet a later block in one task, about ``block`` * ``block`` pairs. A pair is made at the least name that both have, so
    pairs never move.

    The rows come in an order that Parquet stores in a fraction of a byte: each contact of a block goes through the same sequence of the
    later block, both by messages, and a task has few enough contacts for one dictionary.
    """
    spark = book.sparkSession
    rows = staged(_named(book, min_messages).orderBy("name_key", "primary_address", "contact_id").withColumn("row", F.monotonically_increasing_id()), "named")
    part = F.shiftright("row", 33).alias("part")  # of the sorted rows: a common name has several
    runs = rows.groupBy("name_key", part).agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("held"))
    size = max(block // 16 * 8, 1)  # eights, which Parquet packs in whole bytes
    name, cut = Window.partitionBy("name_key"), F.ceil(F.col("held") / size)
    before = F.sum(cut).over(name.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = staged(runs.select("name_key", "part", "start", "held", F.coalesce(before, F.lit(0)).alias("before"), F.sum(cut).over(name).alias("blocks"), F.sum("held").over(name).alias("members")).filter("members > 1"), "runs")
    pairs = runs.agg(F.sum(F.col("held") * (F.col("members") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, int(pairs // (8 * block * block))))  # small as the sides are, their pairs are many: not to be coalesced
    k = F.col("before") + F.floor((F.col("row") - F.col("start") + cut * size - F.col("held")) / size)  # a run's first block is the short one
    one = F.struct("n", F.col("primary_address").alias("address"), F.col("contact_id").alias("id"), F.when(F.size("name_keys") > 1, F.col("name_keys")).alias("keys"))
    dealt = rows.withColumn("part", part).join(runs, ["name_key", "part"])
    blocks = staged(dealt.groupBy("name_key", "blocks", k.alias("k")).agg(F.array_sort(F.collect_list(one)).alias("held")), "blocks")
    four = F.floor(F.col("k") / 4)
    x = blocks.select("name_key", "k", four.alias("lo"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("hi"), F.col("held").alias("xs"))
    y = blocks.select("name_key", F.explode(F.sequence(F.lit(0).cast("long"), four)).alias("lo"), F.col("k").alias("hi"), F.col("held").alias("ys"))
    each = lambda c: F.inline(c).alias(*(f"{f}_{c[0]}" for f in ("n", "address", "id", "keys")))
    x = x.repartition(tasks, "name_key", "lo", "hi").select("name_key", "k", "lo", "hi", each("xs"))
    y = y.repartition(tasks, "name_key", "lo", "hi").hint("merge")  # so that contacts stream past the one row of the other block
    met = x.join(y, ["name_key", "lo", "hi"]).select("name_key", "k", "hi", *(f"{f}_x" for f in ("n", "address", "id", "keys")), each("ys"))
    once = (F.col("k") < F.col("hi")) | (F.struct("address_x", "id_x") < F.struct("address_y", "id_y"))
    first = F.col("keys_x").isNull() | F.col("keys_y").isNull() | (F.element_at(F.array_intersect("keys_x", "keys_y"), 1) == F.col("name_key"))  # in the order of keys_x, which is sorted
    swap = lambda c: (F.when(F.col("id_x") < F.col("id_y"), F.col(f"{c}_{p}")).otherwise(F.col(f"{c}_{q}")).alias(f"{c}_{o}") for o, p, q in (("a", "x", "y"), ("b", "y", "x")))
    return met.filter(once & first).select(*swap("id"), "name_key", (F.col("n_x") + F.col("n_y")).alias("volume"), *swap("address"))


def merge(contacts: DataFrame, book: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contacts, address book, snapshots) after a batch of ``merges`` (source_id, target_id).

    Addresses move to the target; tags are united, the target's first; notes are joined by a rule; the target's name and
    manual kind win over the sources', unknown kinds give way. Each source and its addresses are kept as a snapshot.
    """
    moved = book.join(merges, book.contact_id == merges.source_id, "left")
    new_book = moved.withColumn("contact_id", F.coalesce("target_id", "contact_id")).drop("source_id", "target_id")
    held = book.groupBy("contact_id").agg(F.array_sort(F.collect_list("address")).alias("addresses"))
    src = contacts.join(merges, contacts.id == merges.source_id)
    snapshots = src.join(held, src.id == held.contact_id, "left").select("source_id", "target_id", F.struct("id", "display_name", "kind", "kind_source", "tags", "notes").alias("contact"), "addresses")
    gathered = src.groupBy("target_id").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "tags"))), lambda s: F.coalesce(s["tags"], F.array().cast("array<string>"))))).alias("more_tags"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "notes"))), lambda s: s["notes"]), "\n---\n").alias("more_notes"),
        F.min_by("display_name", F.struct(F.col("display_name").isNull(), F.col("source_id"))).alias("other_name"),
        F.min_by(F.struct("kind", "kind_source"), F.struct(F.col("kind_source") != "manual", F.col("kind") == "unknown", F.col("source_id"))).alias("other"),
    )
    rest = contacts.join(merges, contacts.id == merges.source_id, "left_anti").join(gathered, F.col("id") == F.col("target_id"), "left")
    take = F.col("other").isNotNull() & (F.col("kind_source") != "manual") & ((F.col("other.kind_source") == "manual") | (F.col("kind") == "unknown"))
    notes = F.concat_ws("\n---\n", F.when(F.col("notes") != "", F.col("notes")), F.when(F.col("more_notes") != "", F.col("more_notes")))
    out = rest.select(
        "id", F.coalesce("display_name", "other_name").alias("display_name"), F.when(take, F.col("other.kind")).otherwise(F.col("kind")).alias("kind"), F.when(take, F.col("other.kind_source")).otherwise(F.col("kind_source")).alias("kind_source"),
        F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("more_tags", F.array().cast("array<string>"))).alias("tags"), notes.alias("notes"),
    )
    return out, new_book, snapshots


def unmerge(contacts: DataFrame, book: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restores snapshots: their contacts return, and their addresses that still exist; the target keeps its own fields."""
    back = snapshots.select("contact.*")
    owned = snapshots.select("source_id", F.explode("addresses").alias("address"))
    return contacts.unionByName(back, allowMissingColumns=True), book.join(owned, "address", "left").withColumn("contact_id", F.coalesce("source_id", "contact_id")).drop("source_id")


def set_kind(contacts: DataFrame, book: DataFrame, kind: str, *, domain: str | None = None, addresses: list[str] | None = None, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(contacts with the kind set by hand, the rows that change): chosen by domain, addresses or ids, of which one must be given."""
    if sum(x is not None for x in (domain, addresses, ids)) != 1:
        raise ValueError("give one of domain, addresses, ids")
    pick = F.split_part("address", F.lit("@"), F.lit(2)) == domain if domain is not None else F.col("address").isin(addresses or []) if addresses is not None else F.col("contact_id").isin(ids or [])
    chosen = book.filter(pick).select(F.col("contact_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = contacts.join(chosen, "id", "left")
    done = rows.withColumns({"kind": F.when(F.col("hit"), F.lit(kind)).otherwise(F.col("kind")), "kind_source": F.when(F.col("hit"), F.lit("manual")).otherwise(F.col("kind_source"))}).drop("hit")
    return done, contacts.join(chosen.select("id"), "id", "left_semi")


def curated(computed: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """Computed rows under an overlay of curated fields, which win where they are not null."""
    fields = [c for c in overlay.columns if c != key]
    renamed = overlay.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return computed.join(renamed, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*(f"_{c}" for c in fields))


def thread_counts(book: DataFrame, mails: DataFrame) -> DataFrame:
    """contact_id, threads: distinct threads in which an address of the contact writes; contacts that write in none have no row."""
    rows = mails.filter("thread_id is not null").select("thread_id", normalised("sender_address").alias("address")).distinct()
    return rows.join(book.select("address", "contact_id"), "address").groupBy("contact_id").agg(F.countDistinct("thread_id").alias("threads"))


def profiles(book: DataFrame, mails: DataFrame, merges: DataFrame) -> DataFrame:
    """contact_id, class ('owner' or 'external'), addresses (by volume, with figures), threads, merged (newest first): one row a contact.

    ``merges`` has source_id, target_id, merged_at: those whose target the contact is can be undone.
    """
    one = F.struct((-(F.col("messages_from") + F.col("messages_to"))).alias("rank"), "address", "is_user", "messages_from", "messages_to", "first_seen", "last_seen")
    cards = book.groupBy("contact_id").agg(F.when(F.bool_and("is_user"), "owner").otherwise("external").alias("class"), F.array_sort(F.collect_list(one)).alias("addresses"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("merged_at", "source_id"))))
    held = merges.groupBy(F.col("target_id").alias("contact_id")).agg(newest.alias("merged"))
    rows = cards.join(thread_counts(book, mails), "contact_id", "left").join(held, "contact_id", "left")
    none = F.array().cast("array<struct<merged_at:timestamp,source_id:string>>")
    return rows.select("contact_id", "class", "addresses", F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("merged", none).alias("merged"))


def probability_bands(scores: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """One row: how many human probabilities are below ``low``, up to ``high``, and above."""
    p = F.col("human_probability")
    return scores.agg(F.count_if(p < low).alias("low"), F.count_if((p >= low) & (p <= high)).alias("middle"), F.count_if(p > high).alias("high"))


def resolve_substrings(names: DataFrame, cards: DataFrame) -> DataFrame:
    """name, address: an e-mail address stands for itself; a name resolves where it is part, in any case, of the display name, a name
    variant or an address of exactly one contact with addresses.

    Trigrams of the names meet trigrams of the contacts' texts in an equi-join on the name's rarest trigram, so no name is compared with
    every contact; names of fewer than three characters are looked up among all substrings of their length.
    """
    exact = names.filter(F.col("name").contains("@")).select("name", normalised("name").alias("address"))
    asked = names.filter(~F.col("name").contains("@") & (F.trim("name") != "")).select("name", F.lower(F.trim("name")).alias("low")).distinct()
    texts = cards.filter(F.size("addresses") > 0).select("contact_id", "primary_address", F.explode(F.array_distinct(F.transform(F.concat("name_variants", "addresses", F.array_compact(F.array("display_name"))), F.lower))).alias("known"))
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    found = None
    for n in (1, 2, 3):
        wanted = asked.filter(F.length("low") == n if n < 3 else F.length("low") >= n)
        parts = texts.select("contact_id", "primary_address", "known", F.explode(pieces(F.col("known"), n)).alias("piece"))
        often = parts.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
        rarest = wanted.select("name", "low", F.explode(pieces(F.col("low"), n)).alias("piece")).join(often, "piece", "left").groupBy("name", "low").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)), "piece")).alias("piece"))
        rarest = staged(rarest, "rarest")
        asked_for = staged(rarest.select("piece").distinct(), "pieces")  # few: its size is known when the join is planned, so pieces that all contacts have are not dealt
        hits = rarest.join(parts.join(asked_for, "piece", "left_semi"), "piece").filter(F.contains("known", "low")).select("name", "contact_id", "primary_address").distinct()
        found = hits if found is None else found.unionByName(hits)
    alone = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("primary_address").alias("address")).filter("n = 1")
    return exact.unionByName(alone.select("name", "address"))


def resolve_names(names: DataFrame, cards: DataFrame) -> DataFrame:
    """name, address: an e-mail address stands for itself; a name resolves where exactly one contact with that name has addresses."""
    exact = names.filter(F.col("name").contains("@")).select("name", normalised("name").alias("address"))
    known = cards.select("contact_id", "primary_address", F.explode(F.array_distinct(F.concat("name_variants", F.array_compact(F.array("display_name"))))).alias("known")).select("contact_id", "primary_address", name_key("known").alias("k")).distinct()
    found = names.filter(~F.col("name").contains("@")).select("name", name_key("name").alias("k")).join(known, "k")
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return exact.unionByName(found.withColumn("n", n).filter("n = 1").select("name", F.col("primary_address").alias("address")))
