"""Operator 10, MinHash near-dedup: odd sketches verify banded candidates, full shingle sets confirm them.

How the work is spread:

1. One Arrow pass gives each document its shingle count, a 128-bit fingerprint of its shingle set, a band key for every group
   of MinHash values, and an odd sketch: the MinHash values folded into a parity bitmap. Documents with equal fingerprints are
   one class; everything below works on one representative a class, so exact copies cost nothing more.
2. Band buckets are never expanded into all pairs. In each bucket the *hub*, the member that meets most others over all bands,
   is paired with every other member (a star). The text that near copies were made from meets more copies than they meet each
   other, so its star links most of a group at once, however large that is.
3. Pairs pass if the XOR population count of their odd sketches allows the similarity within a wide margin; then both full
   sets are intersected. A hub of many pairs is dealt to many tasks.
4. Linked members form components. Members of buckets that still hold several components get the missing comparisons, inside tasks
   that hold two bounded blocks of a bucket's whole sets and give back only links between components. So every pair that shares a
   bucket is compared or already connected, and no link is lost to the stars. For a bucket of n members that the stars leave apart
   this part takes n * n comparisons and n / ``block_rows`` copies of each member's set; it never makes a row for each pair. Buckets
   with the same members are compared once. The links between components, usually few, are joined by a second, small run of
   components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.hot import hot_join, hot_keys
from lettermill.llm.words import PRIME, arrow_map, mixed, shingles, split_words
from lettermill.operators.components import connected_components
from lettermill.staging import staged

SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_1", pa.int64()), ("print_2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
SIGNATURE_DDL = "doc_id long, n_shingles long, print_1 long, print_2 long, sketch array<long>, bands array<long>"


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """MinHash samples (one of each permutation) folded into a parity bitmap of ``bits`` bits, as 64-bit words."""
    at = mixed(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(PRIME)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_similarity(differing_bits: int, n_samples: int, bits: int) -> float:
    """Estimated Jaccard similarity of two sets whose sketches differ in so many bits."""
    share = 1 - 2 * differing_bits / bits
    return -math.inf if share <= 0 else 1 + bits / (4 * n_samples) * math.log(share)


def most_differing_bits(similarity: float, n_samples: int, bits: int) -> int:
    """The largest XOR population count at which ``odd_similarity`` is at least ``similarity``."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * n_samples * (1 - similarity) / bits)))


def minhash(values: np.ndarray, n_samples: int, block: int = 256) -> np.ndarray:
    """The least value of each of ``n_samples`` permutations."""
    factors = mixed(np.arange(1, n_samples + 1, dtype=np.uint64) * np.uint64(PRIME)) | np.uint64(1)
    least = np.full(n_samples, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), block):
        np.minimum(least, (values[i : i + block, None] * factors).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, *, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    n = bands * rows

    def sign(text: bytes | None) -> tuple:
        s = shingles(split_words((text or b"").lower()), width)
        if not len(s):
            return 0, None, None, None, None
        print_1, print_2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
        m = minhash(s, n)
        keys = m.reshape(bands, rows)
        out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(PRIME)
        for j in range(rows):
            out = mixed(out + keys[:, j] * np.uint64(2 * j + 3))
        return len(s), int(print_1), int(print_2), odd_sketch(m, bits), out.view(np.int64)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(sign, SIGNATURE), SIGNATURE_DDL)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the wanted representatives; a row for each of their texts."""
    schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id", "text"])
    made = wanted.mapInArrow(arrow_map(lambda t: (shingles(split_words((t or b"").lower()), width).view(np.int64),), schema), "id long, set array<long>")
    return made.filter("size(set) > 0")


def _stars(members: DataFrame, hubs: DataFrame, reps: DataFrame, total: int, most: int) -> DataFrame:
    """(id, hub): members whose sketch is near enough to that of a bucket's hub."""
    sketches = reps.select("id", "sketch")
    known = staged(hubs.join(sketches.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub"), "hubs")
    pairs = hot_join(members.select("id", "band"), known, ["band"], "n", total).filter("id != hub").select("id", "hub", "hub_sketch").distinct()
    far = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(sketches, "id").filter(far <= most).select("id", "hub").distinct()


def _links(stars: DataFrame, sets: DataFrame, *, similarity: int, salts: int = 256) -> DataFrame:
    """The pairs (id, hub) whose full sets reach the similarity in percent; hot hubs are dealt to ``salts`` tasks."""
    hot = hot_keys(stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "n", stars.count()).select("hub", F.lit(True).alias("hot"))
    marked = stars.join(F.broadcast(hot), "hub", "left").select("id", "hub", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).alias("salt"))
    of_hub = sets.select(F.col("id").alias("hub"), F.col("set").alias("hub_set")).join(F.broadcast(hot), "hub", "left")
    none = F.lit(0).cast("long")
    of_hub = of_hub.select("hub", "hub_set", F.explode(F.when(F.col("hot"), F.sequence(none, none + (salts - 1))).otherwise(F.array(none))).alias("salt"))
    full = marked.join(sets, "id").join(of_hub, ["hub", "salt"])
    schema = pa.schema([("id", pa.int64()), ("hub", pa.int64())])

    def confirm(batches):
        for batch in batches:
            (v, at), (w, to) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[2:])
            keep = []
            for i in range(len(batch)):
                x, y = v[at[i] : at[i + 1]], w[to[i] : to[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return full.select("id", "hub", "set", "hub_set").mapInArrow(confirm, "id long, hub long")


def near_duplicates(docs: DataFrame, *, width: int = 5, similarity: int = 75, bands: int = 32, rows: int = 4, bits: int = 512, margin: float = 0.2, block_rows: int = 1024) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles (A-Z lower-cased, words cut at
    ASCII white space) is at least ``similarity`` percent. ``bands`` times ``rows`` MinHash values miss a pair at 0.75 with a
    probability of 5e-6; the sketch check of the stars lets pairs pass that look ``margin`` below the threshold, and pairs it stops
    are compared in blocks of ``block_rows`` members.

    Null or empty texts and texts of white space only have no shingles: they are linked with nothing and kept, their component is
    their own doc_id. Fewer words than ``width`` make one shingle; texts of any length are taken whole. Rows with a null doc_id take
    part in no link; they get a null component and are kept unless they equal another document's set. A repeated row is a copy of
    itself and gives a row again. Rows that repeat a doc_id with other texts are one document: it is linked where any of its texts
    is, and each row has the document's component. Only doc_id and text are read, so other columns cannot clash. No rows give no rows.
    """
    sig = staged(signatures(docs, width=width, bands=bands, rows=rows, bits=bits), "signatures")
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    least = some.groupBy("print_1", "print_2").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sketch", "bands")).alias("r"))
    reps = staged(least.select("print_1", "print_2", "r.*"), "classes")
    found = _component_of(reps, some, docs, width=width, similarity=similarity, most=most_differing_bits(similarity / 100 - margin, bands * rows, bits), block_rows=block_rows)
    of_class = reps.join(found, reps["id"] == found["node"], "left").select("print_1", "print_2", F.coalesce("component", "id").alias("component"))
    out = sig.select("doc_id", "n_shingles", "print_1", "print_2").join(of_class, ["print_1", "print_2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _several_texts(some: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, hub): the classes of documents whose rows have several texts, each tied to the document."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("print_1", "print_2") for n, f in (("low", F.min), ("high", F.max))]
    torn = some.groupBy("doc_id").agg(*ends).filter("low_print_1 != high_print_1 or low_print_2 != high_print_2").select("doc_id")
    return some.select("doc_id", "print_1", "print_2").join(torn, "doc_id", "left_semi").join(reps.select("print_1", "print_2", "id"), ["print_1", "print_2"]).select("id", F.col("doc_id").alias("hub"))


def _component_of(reps: DataFrame, some: DataFrame, docs: DataFrame, *, width: int, similarity: int, most: int, block_rows: int) -> DataFrame:
    """(node, component) of the class representatives that have a link or share a bucket."""
    keys = reps.select("id", "size", F.explode("bands").alias("band"))
    total = max(reps.count() * 32, 1)
    shared = staged(keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = staged(hot_join(keys, shared, ["band"], "n", total), "members")
    meets = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("meets"))
    hubs = members.join(meets, "id").groupBy("band").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("hub"), F.max("n").alias("n"))
    stars = staged(_stars(members, hubs, reps, total, most), "stars")
    sets = staged(_sets(docs, meets.select("id"), width), "sets")
    linked = _links(stars, sets, similarity=similarity).unionByName(_several_texts(some, reps))
    first = staged(connected_components(linked, "id", "hub"), "components")
    placed = members.select("band", "id", "size").join(first.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("c"))
    placed = staged(placed, "placed")
    more = _missing_links(placed, sets, total, similarity, block_rows)
    joined = staged(connected_components(more, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("whole")), "joined")
    of_node = placed.select(F.col("id").alias("node"), F.col("c").alias("component")).unionByName(first).distinct()
    return of_node.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _missing_links(placed: DataFrame, sets: DataFrame, total: int, similarity: int, block_rows: int, block_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) between components c of ``placed`` (band, id, size, c) members that share a bucket.

    The members of a bucket are dealt into blocks of bounded rows and bytes, each pair of blocks of a bucket is one piece of work, and
    the piece intersects whole sets through the shingles' owners. Only links that join two components leave it.
    """
    buckets = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    buckets = buckets.filter("low != high").groupBy("n", "bytes", "mark").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("bytes") / block_bytes)).cast("int")
    split = hot_join(placed, staged(buckets.select("band", "n", blocks.alias("blocks")), "mixed"), ["band"], "n", total)
    known = split.join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rows = known.select("band", "id", "c", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "set")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "c")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            cs = batch.column(3).to_pylist()
            values, at = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            for r, k in enumerate(keys):
                if k != key and held:
                    yield from _joining(held, similarity, schema)
                    held = []
                key = k
                held.append((cs[r], values[at[r] : at[r + 1]].copy()))
        if held:
            yield from _joining(held, similarity, schema)

    return dealt.mapInArrow(compare, "a long, b long")


def _joining(members: list[tuple[int, np.ndarray]], similarity: int, schema: pa.Schema):
    """The components that links among (component, set) members join, as record batches of pairs."""
    cs, sets = [m[0] for m in members], [m[1] for m in members]
    root = {c: c for c in cs}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(root) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(term)
    starts = np.concatenate([[0], np.cumsum(df)])
    owners = owner[np.argsort(term, kind="stable")]  # of each shingle in turn
    ends = np.cumsum(sizes)
    out: list[tuple[int, int]] = []
    able = np.bincount(owner, weights=(df > 1)[term], minlength=len(sets))
    main = _most_common(cs)
    for x in np.flatnonzero(100 * able >= similarity * sizes).tolist():
        if cs[x] == main:
            continue
        terms = term[ends[x] - sizes[x] : ends[x]]
        terms = terms[df[terms] > 1]
        take = np.repeat(starts[terms] - np.concatenate([[0], np.cumsum(df[terms])[:-1]]), df[terms]) + np.arange(df[terms].sum())
        both = np.bincount(owners[take], minlength=len(sets))
        for y in np.flatnonzero((100 + similarity) * both >= similarity * (sizes[x] + sizes)).tolist():
            p, q = find(cs[x]), find(cs[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(cs[x], cs[y]), max(cs[x], cs[y])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


def _most_common(values: list[int]) -> int:
    found, counts = np.unique(values, return_counts=True)
    return int(found[counts.argmax()])
