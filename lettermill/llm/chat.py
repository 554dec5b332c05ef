"""Operator 4, chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of turn tokens cut each conversation into turn-aligned spans. A window is a span with the conversation's system turn
and a limited history of the turns before it repeated in front; only the span's own assistant texts are under the loss mask, so a
repeated target is masked out. A conversation may hold any share of all rows: its prefix sums are taken in blocks of turns, whose
sums alone are put in order, and history is found by an equi-join on buckets of the prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.staging import staged

#: Marks of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Backslashes doubled, then a backslash put into every ``<|``: no control string is left, and ``unescape`` is exact."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; line feeds, which end the role in the template, become ``<\\n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def turn_tokens(role: Column, text: Column) -> Column:
    """The size of a turn against the budget: a token for every four bytes, and four for its marks."""
    return (F.ceil((F.octet_length(role) + F.octet_length(text)) / 4) + 4).cast("long")


#: A conversation's key without nulls, so that joins on it are plain equi-joins and keep a partitioning.
KEY = ["k", "no_id"]


def _placed(turns: DataFrame, budget: int, history: int, system_role: str, block_turns: int) -> DataFrame:
    """Each turn with ``before``, the tokens of the conversation's earlier turns, the ``part`` and ``long`` of its span, and ``serves``.

    Sums of blocks of turns, put in order, are joined to the texts, which move once, by block. ``serves`` is false only for turns
    that no later span can repeat: none starts within ``history`` tokens of the turn's start, and the block ends beyond them too.
    """
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    systems = turns.filter(F.col("role") == system_role).groupBy(KEY).agg(F.min(F.struct("turn", "text", "tokens"))["tokens"].alias("s_tokens"))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)))
    half = F.greatest(F.lit(1), F.floor(F.col("room") / 2))
    sums = turns.select(*KEY, "block", "tokens").join(systems, KEY, "left").withColumn("room", room).withColumn("half", half)
    sums = sums.groupBy(*KEY, "block").agg(F.sum("tokens").alias("t"), F.sum((F.col("tokens") > F.col("half")).cast("long")).alias("l"), F.max("room").alias("room"), F.max("half").alias("half"))
    earlier = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "block", "t", "room", "half", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l0"))
    block = Window.partitionBy(*KEY, "block")
    inside = block.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.join(starts, [*KEY, "block"]).withColumn("is_long", (F.col("tokens") > F.col("half")).cast("long"))
    rows = rows.withColumns({"before": F.col("t0") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)), "long_before": F.col("l0") + F.coalesce(F.sum("is_long").over(inside), F.lit(0))})
    rows = rows.withColumns({"part": F.floor(F.col("before") / F.col("half")), "long": 2 * F.col("long_before") + F.col("is_long")})
    last = F.lag(F.struct("part", "long")).over(block.orderBy("before"))
    rows = rows.withColumn("opens", ~F.struct("part", "long").eqNullSafe(last))
    ahead = F.max("opens").over(block.orderBy("before").rangeBetween(1, max(history, 1)))
    serves = (F.col("tokens") <= history) & (F.coalesce(ahead, F.lit(False)) | (F.col("before") + history >= F.col("t0") + F.col("t")))
    return rows.select(*KEY, "part", "long", "before", "tokens", "room", "role", "text", serves.alias("serves"))


def chat_windows(conversations: DataFrame, *, budget: int = 2048, history: int = 256, target_role: str = "assistant", system_role: str = "system", block_turns: int = 256) -> DataFrame:
    """conv_id, span, text, n_context, n_turns, tokens, over_budget, loss: one row a window.

    ``text`` is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn, with roles and texts escaped. The first ``n_context`` turns
    are repeated (the first system turn, if it came before, then up to ``history`` tokens of earlier turns), the other
    ``n_turns`` are the span's own: over all windows each turn is one of these once, in order of ``span``. ``loss`` lists
    (start, length) of the own target texts in code points. A window stays within ``budget`` tokens unless a single turn is too
    long, which then stands alone in its span (``over_budget``); turns are never cut or dropped.

    Turns are ordered by turn (null first), then role and text, so ties have one order; repeated rows are turns of their own. Null
    roles and texts count as empty; a null conv_id is a conversation like any other. A conversation of empty texts has
    windows like any other. Only conv_id, turn, role and text are read. No rows give no rows.
    """
    conv = F.col("conv_id").cast("long")
    turns = conversations.select(F.coalesce(conv, F.lit(0)).alias("k"), conv.isNull().alias("no_id"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    placed = staged(_placed(turns, budget, history, system_role, block_turns), "turns")
    spans = placed.groupBy(*KEY, "part", "long").agg(F.min("before").alias("span"))
    window = [*KEY, "part", "long"]
    member = lambda kind: [*window, F.lit(kind).alias("kind"), F.col("before").alias("at"), "role", "text", "tokens"]
    reach = 4 * max(history, 1)
    end = F.col("before") + F.col("tokens")
    past = placed.filter("serves").select(*KEY, "before", end.alias("end"), "role", "text", "tokens", F.explode(F.sequence(F.floor(end / reach), F.floor((F.col("before") + history) / reach))).alias("bucket"))
    heads = spans.withColumn("bucket", F.floor(F.col("span") / reach))
    held = past.join(heads, [*KEY, "bucket"]).filter((F.col("span") >= F.col("end")) & (F.col("span") <= F.col("before") + history))
    rules = placed.filter(F.col("role") == system_role).groupBy(KEY).agg(F.min(F.struct("before", "role", "text", "tokens")).alias("rule")).select(*KEY, "rule.*")
    ruled = spans.join(rules, KEY).filter(F.col("span") > F.col("before"))
    return _written(placed.select(member(2)).union(held.select(member(1))).union(ruled.select(member(0))), window, budget, target_role)


def _written(rows: DataFrame, window: list[str], budget: int, target_role: str) -> DataFrame:
    """The windows' texts and masks from their turns: kind 0 system, 1 history, 2 own. History never says the system turn again."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    part = F.struct("kind", "at", "tokens", head.alias("head"), body.alias("body"), ((F.col("kind") == 2) & (F.col("role") == target_role)).alias("target"))
    windows = rows.groupBy(window).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("span"))  # bounded by the budget or one turn
    again = lambda p: (p["kind"] == 1) & (F.get("parts", F.lit(0))["kind"] == 0) & (p["at"] == F.get("parts", F.lit(0))["at"])
    windows = windows.select(F.when(~F.col("no_id"), F.col("k")).alias("conv_id"), "span", F.filter("parts", lambda p: ~again(p)).alias("parts"))
    windows = windows.withColumn("tokens", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END) + 1
    lengths = windows.select("*", F.transform("parts", size).alias("sizes"))
    sums = F.aggregate("sizes", F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    at = lengths.select("*", sums.alias("starts"))
    marks = F.transform("parts", lambda p, i: F.struct((F.get("starts", i) + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"), p["target"].alias("target")))
    loss = F.transform(F.filter(marks, lambda m: m["target"]), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    context = F.size(F.filter("parts", lambda p: p["kind"] < 2)).cast("long")
    return at.select("conv_id", "span", text.alias("text"), context.alias("n_context"), (F.size("parts") - context).alias("n_turns"), "tokens", (F.col("tokens") > budget).alias("over_budget"), loss.alias("loss"))


def _turns_of(said: Column, n_context: Column, n_turns: Column) -> Column:
    """The own turns (role, text) that a window's text says."""
    pieces = F.slice(F.split(said, r"<\|im_start\|>", -1), n_context.cast("int") + 2, n_turns.cast("int"))
    role = lambda p: F.substring_index(p, "\n", 1)
    text = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - len(END) - 2)
    return F.transform(pieces, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, span, turns (array of role and text): the own turns of each window, read back from its text."""
    return windows.select("conv_id", "span", _turns_of(F.col("text"), F.col("n_context"), F.col("n_turns")).alias("turns"))


def read_loss(windows: DataFrame) -> DataFrame:
    """conv_id, span, targets (array of texts): what the loss mask of each window covers, unescaped."""
    return windows.select("conv_id", "span", F.transform("loss", lambda m: unescape(F.substring("text", m["start"] + 1, m["length"]))).alias("targets"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the windows say, conversation by conversation.

    A window moves only its own part, once, and is read where its conversation is gathered.
    """
    before = F.aggregate(F.slice(F.split("text", r"<\|im_start\|>", -1), F.lit(2), F.col("n_context").cast("int")), F.lit(0), lambda n, p: n + F.length(p) + len(START))
    rows = windows.select("conv_id", "span", "n_turns", "text", "loss", F.length("text").cast("long").alias("chars"), before.alias("skip"))
    own = F.struct("span", F.expr("substring(text, skip + 1)").alias("text"), F.lit(0).alias("n_context"), "n_turns", F.transform("loss", lambda m: F.struct((m["start"] - F.col("skip")).alias("start"), m["length"].alias("length"))).alias("loss"))
    gathered = rows.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(own)).alias("w"), F.sum("chars").alias("formatted_chars"))
    said = lambda w: F.array_join(F.transform(_turns_of(w["text"], w["n_context"], w["n_turns"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = lambda w: F.array_join(F.transform(w["loss"], lambda m: unescape(F.substring(w["text"], m["start"] + 1, m["length"]))), "")
    gathered = gathered.select("conv_id", "n_turns", F.array_join(F.transform("w", said), "").alias("said"), F.array_join(F.transform("w", lost), "").alias("lost"), "formatted_chars")
    return gathered.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
