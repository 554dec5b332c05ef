"""Operator 13, phrase collocations by vertically partitioned suffix trees.

Phrases are short, so the suffix tree of a corpus is wanted only down to ``max_words`` words, and only where its nodes are frequent.

1. Frequent words: each task counts the words of a block of text and hands over a 64-bit key and a count each; Spark sums the
   blocks, and the frequent words make a Bloom filter.
2. Frequent pairs: the same for pairs whose words pass that filter; they make a second filter. Filters have a bounded size and only
   save work: what they let pass is counted exactly below, and what is frequent always passes.
3. Suffixes: the text from each word on, cut after ``max_words`` words, at the end of its piece or before a pair that is not
   frequent. A block hands over each distinct suffix with its count, as word hashes.
4. Vertical partitioning: suffixes are dealt by their first word. A prefix with more suffixes than a share of the memory budget is
   extended by a word, until what begins with it fits or is a single suffix. The prefixes are dealt to as many groups as the budget
   asks for, so no group depends on one frequent word.
5. Each group's suffixes arrive in order, which is the order of the leaves of its subtree. The counts of the nodes are read from leaf
   totals while they pass; a group holds the path to one leaf. Nodes above an extended prefix come from the counts that extended it.

The nodes (frequent phrases) are far fewer than the words; scores, nesting and ranks are joins and aggregates over them.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lettermill.llm.words import PRIME, hashed, mixed
from lettermill.staging import staged

#: Where pieces end (fixed values), as line feeds; tabs as spaces; A-Z as a-z; all other bytes stay.
_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(_ENDS + b"\t" + string.ascii_uppercase.encode(), b"\n" * len(_ENDS) + b" " + string.ascii_lowercase.encode())
#: At most so many prefixes of a length are extended (and sent to the tasks): a prefix must hold more than this part of all suffixes.
EXTENDED = 1000


class _Ids(dict):
    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _vocabulary() -> _Ids:
    """Ids of a block's words; the first two are of nothing and of the end of a piece."""
    return _Ids({b"": 0, b"\n": 1})


class Block:
    """Words of a task: ids, the language of each, and how many words its piece has from it on. ``parts``: (language, ids and piece ends)."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], vocabulary: _Ids, names: _Ids):
        all_ids = np.concatenate([ids for _, ids in parts])
        word = all_ids > 1
        self.ids = all_ids[word]
        self.lang = np.repeat(np.array([lang for lang, _ in parts], np.int32), [len(ids) for _, ids in parts])[word]
        piece = np.cumsum(all_ids == 1, dtype=np.int32)[word]
        self.rest = (np.cumsum(np.bincount(piece)).astype(np.int32)[piece] - np.arange(len(piece), dtype=np.int32)) if len(piece) else piece
        self.words, self.names = list(vocabulary), list(names)
        self.hashes = hashed(self.words)
        self.lang_hashes = np.fromiter((xxh3_64_intdigest(x.encode()) for x in self.names), np.uint64, len(self.names))
        #: The place of each word in a table of (language, word).
        self.code = self.lang * np.int64(len(self.words)) + self.ids

    def at(self, values: np.ndarray, k: int, missing: int = 0) -> np.ndarray:
        """``values`` of the k-th next word of the same piece, or ``missing``."""
        out = np.full(len(values), missing, values.dtype)
        out[: max(len(values) - k, 0)] = values[k:]
        out[self.rest <= k] = missing
        return out

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, word, key, count) of each distinct word."""
        counts = np.bincount(self.code, minlength=len(self.words) * len(self.names))
        found = np.flatnonzero(counts)
        lang, word = found // len(self.words), found % len(self.words)
        return lang, word, folded(self.lang_hashes[lang], self.hashes[word]), counts[found]

    def frequent(self, often: Filter) -> np.ndarray:
        """Which words pass the filter."""
        lang, word, keys, _ = self.counted()
        known = np.zeros(len(self.words) * len(self.names), bool)
        known[lang * len(self.words) + word] = often.has(keys)
        return known[self.code]

    def pair_keys(self, lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return folded(folded(self.lang_hashes[lang], self.hashes[one]), self.hashes[two])


def folded(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The key of a phrase that goes on with a word, from the key before (of its language at first)."""
    return mixed((keys + h) * np.uint64(PRIME))


def _stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A text cut at white space into stretches of about ``size`` bytes, so that few of its words are objects at a time."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(b" ", start, start + size), text.rfind(b"\n", start, start + size))
        if cut < start:
            ahead = [x for x in (text.find(b" ", start + size), text.find(b"\n", start + size)) if x >= 0]
            cut = min(ahead, default=len(text))
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:]


def blocks(batches: Iterator[pa.RecordBatch], block_words: int, stretch: int = 1 << 20) -> Iterator[Block]:
    """(lang, text) rows as blocks of whole pieces: about ``block_words`` words, or one piece more."""
    parts, vocabulary, names, held = [], _vocabulary(), _Ids(), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for said in _stretches(text.as_py().encode().translate(TABLE) + b"\n", stretch):
                tokens = said.replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int32, len(tokens))
                ids = ids[ids > 0]
                parts.append((names[lang], ids))
                held += len(ids)
                ends = np.flatnonzero(ids == 1)
                if held >= block_words and len(ends):
                    said_words = list(vocabulary)
                    left = [said_words[i] for i in ids[ends[-1] + 1 :].tolist()]  # of a piece that goes on
                    parts[-1] = (names[lang], ids[: ends[-1] + 1])
                    yield Block(parts, vocabulary, names)
                    parts, vocabulary, names = [], _vocabulary(), _Ids()
                    if left:
                        parts.append((names[lang], np.fromiter(map(vocabulary.__getitem__, left), np.int32, len(left))))
                    held = len(left)
    if parts:
        yield Block(parts, vocabulary, names)


class Filter:
    """A Bloom filter of 64-bit keys with two bits a key."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            found &= (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int) -> Filter:
        """Of the column ``key``; Spark sets the bits, 4 KB a row, and the driver gets ``most_bits`` of them at most."""
        bits = min(most_bits, 1 << max(15, (16 * keys.count()).bit_length()))
        both = [F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1))]
        at = keys.select(F.explode(F.array(*both)).alias("at"))
        made = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
        packed = np.zeros(bits // 8, np.uint8)
        for r in made.collect():
            packed[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return cls(bits, packed)


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows as columns, their counts); values are -1 or more. Rows become one number each where 63 bits can hold them."""
    ranges = [int(c.max(initial=-1)) + 2 for c in columns]
    if math.prod(ranges) >= 1 << 63:
        order = np.lexsort(columns[::-1])
        new = reduce(np.logical_or, (np.diff(c[order]) != 0 for c in columns))
        first = np.flatnonzero(np.concatenate([[True], new]))
        return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))
    packed = np.zeros(len(columns[0]), np.int64)
    for c, n in zip(columns, ranges):
        packed = packed * n + (c + 1)
    packed, counts = np.unique(packed, return_counts=True)
    out = []
    for n in ranges[::-1]:
        packed, rest = np.divmod(packed, n)
        out.append(rest - 1)
    return out[::-1], counts


def _counted(texts: DataFrame, make: Callable[[Block], list], ddl: str, schema: pa.Schema, block_words: int) -> DataFrame:
    """The rows (columns of ``make``) of each block of ``texts`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_words):
            made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(make(block), schema)], schema=schema)
            for i in range(0, len(made), 65_536):
                yield made.slice(i, 65_536)

    return texts.mapInArrow(run, ddl)


def _word_rows(block: Block) -> list:
    _, _, keys, counts = block.counted()
    return [keys.view(np.int64), counts]


def _pair_rows(frequent: Filter) -> Callable[[Block], list]:
    def make(block: Block) -> list:
        known = block.frequent(frequent)
        both = known & block.at(known, 1)
        (lang, one, two), counts = _distinct([block.lang[both], block.ids[both], block.at(block.ids, 1)[both]])
        return [block.pair_keys(lang, one, two).view(np.int64), counts]

    return make


def _suffix_rows(frequent: Filter, pairs: Filter, max_words: int) -> Callable[[Block], list]:
    """Three kinds of rows (lang, w1 ..., c, word): suffixes of two words and more; frequent words, spelt, without w2; totals, without words."""

    def make(block: Block) -> list:
        known = block.frequent(frequent)
        good = known & block.at(known, 1)
        good[good] = pairs.has(block.pair_keys(block.lang[good], block.ids[good], block.at(block.ids, 1)[good]))
        used = np.unique(np.concatenate([block.ids[good], block.at(block.ids, 1)[good], [0]]))  # frequent words only: smaller numbers
        small = np.zeros(len(block.words), np.int32)
        small[used] = np.arange(len(used), dtype=np.int32)
        own = small[block.ids]
        columns, on = [block.lang[good], own[good]], good
        for k in range(1, max_words):
            columns.append(np.where(on, block.at(own, k, -1), -1)[good])
            on = on & block.at(good, k)
        (lang, *words), counts = _distinct(columns)
        words = [np.where(w < 0, -1, used[w]) for w in words]
        of_lang, word, keys, held = block.counted()
        spelt = frequent.has(keys)
        totals = np.bincount(block.lang, minlength=len(block.names))
        langs = np.concatenate([lang, of_lang[spelt], np.arange(len(totals))])
        none = np.full(len(totals), -1)
        blank = np.full(spelt.sum() + len(totals), -1)
        ids = [np.concatenate([words[0], word[spelt], none]), *(np.concatenate([w, blank]) for w in words[1:])]
        said = pa.array(block.words, pa.binary()).cast(pa.string()).take(pa.array(word[spelt]))
        said = pa.concat_arrays([pa.nulls(len(lang), pa.string()), said, pa.nulls(len(totals), pa.string())])
        made = [pa.array(block.hashes[w].view(np.int64), mask=w < 0) for w in ids]
        return [pa.array(block.names, pa.string()).take(pa.array(langs)), *made, np.concatenate([counts, held[spelt], totals]), said]

    return make


def _extended(suffixes: DataFrame, w: list[str], least: int) -> list[DataFrame]:
    """For each length up to ``max_words`` - 1 the prefixes that more than ``least`` suffixes begin with: lang, words, f."""
    out: list[DataFrame] = []
    rows = suffixes
    for d in range(1, len(w)):
        found = rows.groupBy("lang", *w[:d]).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("f")).filter(F.col("n") > least)
        out.append(staged(found.filter(F.col(w[d - 1]).isNotNull()).select("lang", *w[:d], "f"), "extended"))
        rows = rows.join(F.broadcast(out[-1].select("lang", *w[:d])), ["lang", *w[:d]], "left_semi")
    return out


def _grouped(suffixes: DataFrame, w: list[str], extended: list[DataFrame], groups: int) -> DataFrame:
    """The suffixes with the length of their prefix, dealt to ``groups`` by prefix and in the order of leaves within each."""
    length = F.lit(1)
    for d, hot in enumerate(extended, 1):
        mark = hot.select("lang", *w[:d], F.lit(1).alias(f"more_{d}"))  # EXTENDED rows at most
        suffixes = suffixes.join(F.broadcast(mark), ["lang", *w[:d]], "left")
        length = F.when(F.col(f"more_{d}") == 1, d + 1).otherwise(length)
    rows = suffixes.select("lang", *w, "c", length.alias("prefix"))
    own = [F.when(F.col("prefix") > i, F.col(c)) for i, c in enumerate(w)]
    return rows.repartition(groups, "lang", *own).sortWithinPartitions("lang", *w)


def _nodes(grouped: DataFrame, w: list[str], min_count: int) -> DataFrame:
    """(lang, p, f): the nodes of two words and more of each group's subtree, from the totals of their leaves."""
    schema = pa.schema([("lang", pa.string()), ("p", pa.list_(pa.int64())), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: dict[int, list] = {}  # of each depth the open node: [key, total]
        for batch in batches:
            if len(batch):
                yield from leaves(batch, path)
        yield from made([node for node in path.values() if node[1] >= min_count])

    def made(nodes: list) -> Iterator[pa.RecordBatch]:
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in nodes], pa.string()), pa.array([list(k[1:]) for k, _ in nodes], schema[1].type), pa.array([f for _, f in nodes], pa.int64())], schema=schema)

    def leaves(batch: pa.RecordBatch, path: dict[int, list]) -> Iterator[pa.RecordBatch]:
        lang, *words = (batch.column(c) for c in ("lang", *w))
        lang_code = lang.dictionary_encode().indices.to_numpy()
        absent = [x.is_null().to_numpy(zero_copy_only=False) for x in words]
        values = [x.fill_null(0).to_numpy() for x in words]
        c, prefix = batch.column("c").to_numpy(), batch.column("prefix").to_numpy()
        new = np.diff(lang_code) != 0
        for d, (v, gone) in enumerate(zip(values, absent), 1):
            new = new | (np.diff(v) != 0) | (np.diff(gone.astype(np.int8)) != 0)
            if d == 1:
                continue
            first = np.flatnonzero(np.concatenate([[True], new]))
            totals = np.add.reduceat(c, first)
            mine = ~gone[first] & (prefix[first] <= d)
            key = lambda i: (lang[i].as_py(), *(int(values[k][i]) for k in range(d)))
            done = []
            opened = path.pop(d, None)
            last = len(first) - 1
            for j in {0, last}:
                if not mine[j]:
                    continue
                node = [key(int(first[j])), int(totals[j])]
                if j == 0 and opened and opened[0] == node[0]:
                    node[1] += opened[1]
                    opened = None
                if j == last:
                    path[d] = node
                else:
                    done.append(node)
            if opened:
                done.append(opened)
            yield from made([n for n in done if n[1] >= min_count])
            inner = np.arange(1, last)[mine[1:last] & (totals[1:last] >= min_count)]
            if len(inner):
                at = first[inner]
                flat = np.stack([v[at] for v in values[:d]], axis=1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(at)), lists, pa.array(totals[inner])], schema=schema)

    return grouped.mapInArrow(run, "lang string, p array<long>, f long")


def phrase_counts(docs: DataFrame, *, min_count: int = 30, max_words: int = 4, group_rows: int = 1 << 20, block_words: int = 1 << 21, filter_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): lang, p (word hashes), f of each phrase of one to ``max_words`` words found ``min_count`` times or
    more; lang, h, word of its words; lang, n (all words).
    """
    texts = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    key_schema = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def often(make: Callable[[Block], list], name: str) -> Filter:
        rows = _counted(texts, make, "key long, c long", key_schema, block_words)
        return Filter.of(staged(rows.groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= min_count).select("key"), name), filter_bits)

    frequent = often(_word_rows, "frequent_words")
    pairs = often(_pair_rows(frequent), "frequent_pairs")
    w = [f"w{i}" for i in range(1, max_words + 1)]
    schema = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in w), ("c", pa.int64()), ("word", pa.string())])
    ddl = "lang string, " + ", ".join(f"{c} long" for c in w) + ", c long, word string"
    rows = staged(_counted(texts, _suffix_rows(frequent, pairs, max_words), ddl, schema, block_words), "suffixes")
    totals = rows.filter("w1 is null").groupBy("lang").agg(F.sum("c").alias("n")).filter("n > 0")
    words = rows.filter("word is not null").groupBy("lang", "word", F.col("w1").alias("h")).agg(F.sum("c").alias("f")).filter(F.col("f") >= min_count)
    words = staged(words, "words")
    suffixes = rows.filter("w2 is not null").drop("word")
    total = suffixes.count()
    extended = _extended(suffixes, w, total // EXTENDED)
    nodes = _nodes(_grouped(suffixes, w, extended, max(1, -(-total // group_rows))), w, min_count)
    phrases = [words.select("lang", F.array("h").alias("p"), "f"), nodes]
    phrases += [hot.filter(F.col("f") >= min_count).select("lang", F.array(*w[: d + 1]).alias("p"), "f") for d, hot in enumerate(extended) if d]
    return staged(reduce(DataFrame.unionAll, phrases), "phrases"), words.select("lang", "h", "word"), totals


def _share(part: Column, whole: Column, scale: int) -> Column:
    """floor(scale * part / whole), exact however large the product."""
    return F.call_function("div", F.lit(scale).cast("decimal(10,0)") * part.cast("decimal(19,0)"), whole)


def phrase_collocations(docs: DataFrame, *, min_count: int = 30, max_words: int = 4, nested_percent: int = 80, top: int = 2000, group_rows: int = 1 << 20, block_words: int = 1 << 21, filter_bits: int = 1 << 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts, with A-Z lower-cased, are cut at ``[.,;:!?\\\\x0A-\\\\x0D]`` into pieces and those into words ``[^\\\\x20\\\\x09]+``. Candidates
    are phrases of 2 to ``max_words`` words within a piece, found a >= ``min_count`` times, overlaps included. Cut after its first k
    words, a candidate gives l and r, the counts of both parts, and floor(2000000 * a / (l + r)); its score is that of its
    lowest-scoring cut, of equal ones the first. A candidate goes if it lies inside a longer candidate found at least
    ``nested_percent`` of a times, whether that one stays or not. n counts all words of the language. Order: score, then a, both
    descending, then the phrase by its bytes.

    A null lang counts as ``und``; a null text has no words; a language without words has no row. Rows count each by itself, so
    repeated rows and ids count as often; doc_id is not read, nor any other column but text and lang, so names cannot clash. A text
    of any length is taken whole, piece by piece. Words are told apart by 64-bit hashes. No rows give no rows. ``group_rows`` and
    ``block_words`` bound what a task holds and ``filter_bits`` what the driver sends; none of them changes the result.
    """
    if not 2 <= max_words:
        raise ValueError("a phrase has two words or more")
    phrases, words, totals = phrase_counts(docs, min_count=min_count, max_words=max_words, group_rows=group_rows, block_words=block_words, filter_bits=filter_bits)
    found = phrases.filter(F.size("p") > 1).withColumnRenamed("f", "a")
    cuts = found.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    part = lambda c, f: phrases.select("lang", F.col("p").alias(c), F.col("f").alias(f))
    cuts = cuts.select("*", F.slice("p", F.lit(1), F.col("k")).alias("one"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("two"))
    both = cuts.join(part("one", "l"), ["lang", "one"]).join(part("two", "r"), ["lang", "two"])
    score = _share(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"), 2_000_000)
    scored = both.groupBy("lang", "p").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("best"))
    inner = found.filter(F.size("p") > 2).select("lang", "p", "a", F.explode(F.sequence(F.lit(2), F.size("p") - 1)).alias("size"))
    inner = inner.select("lang", "p", "a", "size", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("size") + 1)).alias("at"))
    longer = inner.groupBy("lang", F.slice("p", F.col("at"), F.col("size")).alias("p")).agg(F.max("a").alias("longest"))
    nested = F.col("longest").cast("decimal(19,0)") * 100 >= F.col("best.a").cast("decimal(19,0)") * nested_percent
    stay = scored.join(longer, ["lang", "p"], "left").filter(~F.coalesce(nested, F.lit(False)))
    spelt = stay.select("lang", "p", F.posexplode("p").alias("at", "h")).join(words, ["lang", "h"])
    spelt = spelt.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = stay.join(spelt, ["lang", "p"]).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
