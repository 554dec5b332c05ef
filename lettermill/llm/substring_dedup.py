"""Operator 12, substring dedup by relative Lempel-Ziv parsing: passages that an earlier document has too are taken out.

A window is ``width`` consecutive words. Its anchor is the least hash among its word k-grams (the leftmost of equals), which
depends on the window's words alone, so equal windows meet under one anchor however they are placed.

1. One Arrow pass cuts each text into segments, the runs of windows around one anchor: a row of an anchor, a place and a 128-bit
   print of the segment's words; no words move. Segments with equal prints are one class, whose owner is its smallest doc_id;
   all its windows go from every other document. So exact copies cost a partial aggregation and a join.
2. Where an anchor has several classes they form a reference block. Their words are fetched once from the owners' texts and dealt
   by anchor. In a block the classes are taken in the order of their owners; each is factored greedily against the indexed
   reference (a suffix automaton of what smaller doc_ids have brought), and what is new in it then joins the reference. Windows
   inside factors of ``width`` words and more are duplicates. A window that no factor holds whole has a factor boundary inside, and
   the factor after the first boundary reaches its end, so only windows around boundaries between factors that are long enough
   together are looked up besides: no window is lost.
3. A block of more than ``block_rows`` classes would grow with the corpus. Its classes are cut into a few parts by the place of the
   anchor in the window. The windows of a part all hold a stretch of words around the anchor, whose print is the part's block: a
   common line in other surroundings is alone at once. Parts with equal prints are one class again, and blocks that are still too
   large are cut again, until a part is one window. So a window has one row a level at most, and only where its stretch is that common.
4. The spans of a document are gathered, and the texts move once more, to lose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.hot import hot_join
from lettermill.llm.words import PRIME, hashed, mixed, small, split_words
from lettermill.staging import staged

_BASES = (np.uint64(PRIME), np.uint64(0xD1B54A32D192ED03))
_TURNED = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
KEY = ["anchor", "print_1", "print_2"]


class Prints:
    """128-bit prints of any stretch of a text's words, from prefix sums of a polynomial in each of two bases."""

    def __init__(self, h: np.ndarray):
        self.sums, self.turns = [], []
        for k, (base, back) in enumerate(zip(_BASES, _TURNED)):
            powers, turned = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), x)])) for x in (base, back))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum((mixed(h) if k else h) * powers[:-1])]))
            self.turns.append(turned)

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        length = (end - start).astype(np.uint64)
        return [mixed((s[end] - s[start]) * t[start] + length).view(np.int64) for s, t in zip(self.sums, self.turns)]


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each stretch of ``gram`` words."""
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        grams += h[i : i + len(grams)] * np.uint64(pow(PRIME, i + 1, 1 << 64))
    return mixed(grams)


def segments(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each run of windows that have one anchor; a text of fewer than ``width`` words has none."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = _grams(h, gram)
    span = width - gram + 1
    least, at, held = grams, np.arange(len(grams)), 1
    while held < span:  # the leftmost least of twice as many
        by = min(held, span - held)
        right = least[by:] < least[: len(least) - by]
        least, at, held = np.where(right, least[by:], least[:-by]), np.where(right, at[by:], at[:-by]), held + by
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, n)), least[first].view(np.int64)


def parts(h: np.ndarray, width: int, gram: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """(first window, windows, block, print_1, print_2) of a segment's parts: windows whose anchor lies at one of ``size`` places that
    follow each other. The block is the print of the words that any window of these places holds, and of the places."""
    at, prints = int(np.argmin(_grams(h[:width], gram))), Prints(h)
    places = at - np.arange(len(h) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], np.diff(places // size) != 0]))
    end = np.append(first[1:], len(places))
    low = places[first] // size * size
    high = np.minimum(low + size, width - gram + 1) - 1
    block = mixed(prints.of(at - low, at - high + width)[0].view(np.uint64) + low.astype(np.uint64) * np.uint64(PRIME)).view(np.int64)
    return list(zip(*(x.tolist() for x in (first, end - first, block, *prints.of(first, end + width - 1)))))


class Reference:
    """An index of word sequences that grows: a suffix automaton, in which any stretch of them is a walk from the root."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, steps: dict) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _apart(self, p: int, q: int, word) -> int:
        """The state of the walk over p and ``word``: q, or its copy of the right length."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            if (q := self.next[last].get(w)) is not None:
                last = self._apart(last, q, w)
                continue
            made, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = made
                p = self.link[p]
            if p >= 0:
                self.link[made] = self._apart(p, self.next[p][w], w)
            last = made

    def factors(self, words: list) -> list[tuple[int, int]]:
        """The greedy parse: (start, length) of the longest stretch of the reference from each place on; length 0 for a new word."""
        out, i, n = [], 0, len(words)
        while i < n:
            state, j = 0, i
            while j < n and (to := self.next[state].get(words[j])) is not None:
                state, j = to, j + 1
            out.append((i, j - i))
            i = max(j, i + 1)
        return out

    def windows(self, words: list, width: int) -> np.ndarray:
        """Which windows of ``words`` the reference holds: those inside long factors, and those found around factor boundaries."""
        known = np.zeros(len(words) - width + 1, bool)
        p, before = 0, 0
        for q, length in self.factors(words):
            if length >= width:
                known[q : q + length - width + 1] = True
            if before and before + length >= width and length:
                self._around(words, max(p, q - width + 1), min(q + width - 1, q + length), width, known)
            p, before = q, length
        return known

    def _around(self, words: list, start: int, end: int, width: int, known: np.ndarray) -> None:
        """Marks the windows between two places, by the longest stretch that ends at each word."""
        state, held = 0, 0
        for j in range(start, end):
            while state and words[j] not in self.next[state]:
                state = self.link[state]
                held = self.length[state]
            to = self.next[state].get(words[j])
            state, held = (0, 0) if to is None else (to, held + 1)
            if held >= width:
                known[j - width + 1] = True


def parsed_block(classes: list[tuple[int, list]], width: int) -> list[np.ndarray]:
    """For each (owner, words) of a reference block, in the order of owners: the windows that smaller owners have."""
    reference, out, fresh = Reference(), [], []
    for i, (owner, words) in enumerate(classes):
        if i and owner != classes[i - 1][0]:
            for new in fresh:
                reference.add(new)
            fresh = []
        known = reference.windows(words, width) if len(reference.next) > 1 else np.zeros(len(words) - width + 1, bool)
        out.append(known)
        fresh += [words[a : b + width - 1] for a, b in _runs(~known)]
    return out


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_SEGMENT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("print_1", pa.int64()), ("print_2", pa.int64())])
_SEGMENT_DDL = "doc_id long, text_hash long, start int, windows int, anchor long, print_1 long, print_2 long"


def _segments_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = hashed(split_words(text.as_py().encode()))
                start, windows, anchor = segments(h, width, gram)
                if len(start):
                    prints = Prints(h).of(start, start + windows + width - 1)
                    columns = [np.full(len(start), d), np.full(len(start), t), start.astype(np.int32), windows.astype(np.int32), anchor, *prints]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SEGMENT)

    return rows.mapInArrow(run, _SEGMENT_DDL)


_WORDS = pa.schema([*(_SEGMENT.field(c) for c in KEY), ("doc_id", pa.int64()), ("heavy", pa.bool_()), ("words", pa.binary())])
_WORDS_DDL = "anchor long, print_1 long, print_2 long, doc_id long, heavy boolean, words binary"


def _words_of(texts: DataFrame, width: int) -> DataFrame:
    """The words of each wanted segment. ``texts``: doc_id, text, wanted (list of segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            for d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = split_words(text.as_py().encode())
                rows: list[list] = [[] for _ in _WORDS]
                for s in wanted.as_py():
                    a = s["start"]
                    for column, v in zip(rows, (*(s[c] for c in KEY), d, s["heavy"], b" ".join(words[a : a + s["windows"] + width - 1]))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _WORDS)], schema=_WORDS)

    return texts.mapInArrow(run, _WORDS_DDL)


_SPAN = pa.schema([*(_SEGMENT.field(c) for c in KEY), ("doc_id", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_SPAN_DDL = "anchor long, print_1 long, print_2 long, doc_id long, low int, high int"


def _parsed(blocks: DataFrame, width: int) -> DataFrame:
    """Runs of duplicate windows (low to high) in the classes of light blocks."""

    def spans(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = parsed_block([(r[3], r[4].split(b" ")) for r in held], width)
        out = [(*r[:4], a, b) for r, known in zip(held, found) for a, b in _runs(known)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SPAN)], schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in small(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    yield from spans(held)
                    held = []
                if not held or row[:4] != held[-1][:4]:  # a repeated row of documents gives its words again
                    held.append(row)
        if held:
            yield from spans(held)

    dealt = blocks.select(*KEY, "doc_id", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "print_1", "print_2")
    return dealt.mapInArrow(run, _SPAN_DDL)


_PART = pa.schema([*(_SEGMENT.field(c) for c in KEY), ("doc_id", pa.int64()), ("low", pa.int32()), ("windows", pa.int32()), *((c, pa.int64()) for c in ("block", "part_1", "part_2")), ("words", pa.binary())])
_PART_DDL = "anchor long, print_1 long, print_2 long, doc_id long, low int, windows int, block long, part_1 long, part_2 long, words binary"
_PART_KEY = ["block", "part_1", "part_2"]
#: Into so many parts, or one more, a class of a heavy block is cut at a time.
PARTS = 4


def _parts_of(heavy: DataFrame, width: int, gram: int, size: int) -> DataFrame:
    """The parts of classes, or of parts of them, with their words. ``heavy``: the class, doc_id, low (its first window in the class), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for *key, d, low, said in zip(*(c.to_pylist() for c in batch.columns)):
                words = said.split(b" ")
                for first, n, *block in parts(hashed(words), width, gram, size):
                    out.append((*key, d, low + first, n, *block, b" ".join(words[first : first + n + width - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_PART), _PART)], schema=_PART)

    return heavy.select(*KEY, "doc_id", "low", "words").mapInArrow(run, _PART_DDL)


def _split_blocks(heavy: DataFrame, width: int, gram: int, block_rows: int) -> list[DataFrame]:
    """Runs of duplicate windows in the classes of heavy blocks, which are cut into parts until no block of parts is heavy."""
    size, spans = width - gram + 1, []
    heavy = heavy.withColumn("low", F.lit(0))
    while not heavy.isEmpty():
        size = -(-size // PARTS)
        cut = staged(_parts_of(heavy, width, gram, size), "parts")
        total = max(cut.count(), 1)
        classes = staged(cut.groupBy(*_PART_KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held")), "part_classes")
        blocks = classes.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.max("first").alias("most"))
        blocks = staged(blocks.filter("n > 1 and least < most").select("block", "n"), "part_blocks")
        copied = classes.filter("first < last").select(*_PART_KEY, "first", "held", F.lit(0).cast("long").alias("n"))
        contested = hot_join(classes, blocks, ["block"], "n", max(classes.count(), 1)).select(*copied.columns)
        told = staged(copied.unionAll(contested).groupBy(*_PART_KEY, "first", "held").agg(F.max("n").alias("n")), "told_parts")
        met = hot_join(cut, told, _PART_KEY, "held", total)
        spans.append(met.filter("doc_id > first").select(*KEY, "doc_id", "low", (F.col("low") + F.col("windows")).alias("high")))
        own = staged(met.filter("doc_id = first and n > 0").select(*cut.columns, ((F.col("n") > block_rows) & F.lit(size > 1)).alias("heavy")), "own_parts")
        names = dict(zip(KEY, _PART_KEY))
        found = _parsed(own.filter("not heavy").select(*(F.col(v).alias(k) for k, v in names.items()), "doc_id", "words"), width)
        found = found.select(*(F.col(k).alias(v) for k, v in names.items()), "doc_id", F.col("low").alias("a"), F.col("high").alias("b"))
        placed = own.filter("not heavy").join(found, [*_PART_KEY, "doc_id"])
        spans.append(placed.select(*KEY, "doc_id", (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b")).alias("high")))
        heavy = own.filter("heavy")
    return spans


def duplicate_spans(docs: DataFrame, *, width: int = 50, gram: int = 8, block_rows: int = 256) -> DataFrame:
    """doc_id, text_hash, low, high: runs of windows (first windows, by word) whose words also start in a document with a smaller doc_id.

    ``text_hash`` is Spark's xxhash64 of the text, for rows that repeat a doc_id with other texts: they are one document. Runs of a
    document may repeat, touch or overlap. Null doc_ids have no order: such rows are neither parsed nor a reference. Null, empty and
    short texts (fewer than ``width`` words) have no windows. No rows give no rows.
    """
    if not 1 <= gram <= width:
        raise ValueError("an anchor is a part of the window")
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    cut = staged(_segments_of(rows, width, gram), "segments")
    place = F.struct("doc_id", "text_hash", "start", "windows")
    classes = cut.groupBy(*KEY).agg(F.min(place).alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held"))
    classes = staged(classes.select(*KEY, "owner", "last", "held"), "classes")
    total = max(cut.count(), 1)
    copied = staged(classes.filter("owner.doc_id < last").select(*KEY, F.col("owner.doc_id").alias("first"), "held"), "copied")
    copies = hot_join(cut, copied, KEY, "held", total).filter("doc_id > first")
    whole = copies.select("doc_id", "text_hash", F.col("start").alias("low"), (F.col("start") + F.col("windows")).alias("high"))
    blocks = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("owner.doc_id").alias("low"), F.max("owner.doc_id").alias("high"))
    blocks = staged(blocks.filter("n > 1 and low < high").select("anchor", "n"), "blocks")
    wanted = hot_join(classes.select(*KEY, "owner"), blocks, ["anchor"], "n", max(classes.count(), 1))
    wanted = wanted.select("owner.doc_id", "owner.text_hash", F.struct(*KEY, "owner.start", "owner.windows", (F.col("n") > block_rows).alias("heavy")).alias("s"))
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("wanted"))  # a document's own segments
    said = staged(_words_of(rows.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text", "wanted"), width), "words")
    spans = _parsed(said.filter("not heavy"), width)
    for split in _split_blocks(said.filter("heavy"), width, gram, block_rows):
        spans = spans.unionAll(split)
    spans = spans.withColumnRenamed("doc_id", "owner_id").withColumnRenamed("low", "a").withColumnRenamed("high", "b")
    same = [F.col(f"k.{c}") == F.col(f"s.{c}") for c in KEY]
    placed = cut.alias("k").join(spans.alias("s"), [*same, F.col("k.doc_id") == F.col("s.owner_id")])
    return whole.unionAll(placed.select("k.doc_id", "k.text_hash", (F.col("k.start") + F.col("s.a")).alias("low"), (F.col("k.start") + F.col("s.b")).alias("high")))


def substring_dedup(docs: DataFrame, *, width: int = 50, gram: int = 8, block_rows: int = 256) -> DataFrame:
    """doc_id, n_words, n_removed, text: each word goes that lies in a window of ``width`` words which also starts in a document with
    a smaller doc_id; the words that stay are joined by one space. A row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows are judged on the input, not on what is left. ``gram`` is the length of
    anchors and ``block_rows`` bounds a reference block; neither changes the result. A null text has no words. Rows that repeat a
    doc_id are one document, so none of them is an earlier one of another; each row loses its own words. Rows with a null doc_id
    lose nothing and take nothing from others. Texts are taken whole, whatever their length; a task holds the words of one at a time.
    Only doc_id and text are read, so other columns cannot clash. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = duplicate_spans(docs, width=width, gram=gram, block_rows=block_rows)
    lists = staged(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")  # a document's own runs
    able = F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * width - 1)
    no_spans = F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")
    some = rows.filter(able).withColumn("text_hash", F.xxhash64("text")).join(lists, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    rest = rows.filter(~F.coalesce(able, F.lit(False))).select("doc_id", "text", no_spans)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.large_binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for d, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = split_words((text.as_py() or "").encode())
                gone = _covered(len(words), runs.values, width) if runs.is_valid else np.zeros(len(words), bool)
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words
                out.append((d, len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    made = some.unionAll(rest).mapInArrow(cut, "doc_id long, n_words long, n_removed long, text binary")
    return made.withColumn("text", F.col("text").cast("string"))


def _covered(n: int, runs: pa.StructArray, width: int) -> np.ndarray:
    """The words of ``n`` that lie in a window of the runs."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs.field("low").to_numpy(), 1)
    np.subtract.at(edges, runs.field("high").to_numpy() + (width - 1), 1)
    return np.cumsum(edges[:-1]) > 0
