"""Operator 8, benchmark decontamination by latent semantic retrieval.

1. One Arrow pass turns each text into word hashes, staged in the shared folder; document frequencies are counted over all of
   them.
2. TF-IDF passages (overlapping windows of hashed words) of the benchmark and of a bounded sample of documents, both with the same
   weight, are factorised by a randomised SVD whose products are summed over Spark's tasks.
3. Every passage of every document is projected and compared with all benchmark passages by the cosine of the projections. Both are
   measured in the latent space, so a benchmark of more passages than dimensions costs precision, which step 4 restores, and not
   recall. Whatever holds enough of an item's rarest words is a candidate as well (``RareWords``), whatever its cosine.
4. Candidates are confirmed on the words around them: the longest common subsequence must cover the item's words, so dropped,
   added and exchanged words do not hide an item; an item's answer, if given, must be there too.

The benchmark is the query set. It is read in blocks of at most ``block_items`` items, one pass over the passages a block, so
what a task holds does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from lettermill.llm.counts import summed
from lettermill.llm.sampling import bounded_sample
from lettermill.llm.words import arrow_map, small
from lettermill.staging import staged

#: ASCII signs become spaces, A-Z lower case; all other bytes stay.
TABLE = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))
HASHES = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(TABLE).split()
    return np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))


def places(a: np.ndarray) -> dict[int, int]:
    """For each word of ``a`` the bits of its positions."""
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    return at


def common_length(at: dict[int, int], n: int, b: np.ndarray) -> int:
    """Length of the longest common subsequence of ``b`` and the ``n`` words with these ``places``."""
    full = (1 << n) - 1
    v = full
    for w in b.tolist():
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return n - v.bit_count()


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit of an integer for each word of ``a``."""
    return common_length(places(a), len(a), b)


def window_sums(values: np.ndarray, stride: int) -> np.ndarray:
    """Sums over windows of two strides, one stride apart; a text of up to one stride is one window."""
    blocks = np.add.reduceat(values, np.arange(0, len(values), stride), axis=0)
    return blocks[:-1] + blocks[1:] if len(blocks) > 1 else blocks


@dataclass
class Latent:
    """The projection: a row for each bucket, times its inverse document frequency (in ``basis`` already)."""

    idf: np.ndarray
    basis: np.ndarray
    stride: int

    def passages(self, words: np.ndarray) -> np.ndarray:
        """The projected passages."""
        return window_sums(self.basis[words & np.uint32(len(self.idf) - 1)], self.stride)


@dataclass
class RareWords:
    """Candidates without loss: where a text holds ``overlap`` of an item's n words, at most n - need of its positions are missing,
    so of any n - need + k positions k are there. The rarest are taken; ``share`` has k (1 to 3) of each item.
    """

    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    share: np.ndarray
    sizes: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, items: list[dict], idf: np.ndarray, overlap: float) -> RareWords:
        sizes = np.array([len(i["words"]) for i in items])
        need = np.ceil(overlap * sizes - 1e-9).astype(int)
        share = np.clip(need, 1, 3)
        pairs = []
        for k, i in enumerate(items):
            rarest = np.argsort(-idf[i["words"] & np.uint32(len(idf) - 1)], kind="stable")[: sizes[k] - need[k] + share[k]]
            pairs += [(w, k) for w in np.unique(i["words"][rarest]).tolist()]
        pairs.sort()
        words, first = np.unique(np.array([w for w, _ in pairs], np.uint32), return_index=True)
        marks = np.zeros(1 << 18, bool)
        marks[words & np.uint32(len(marks) - 1)] = True
        return cls(words, np.append(first, len(pairs)), np.array([k for _, k in pairs]), share, sizes, marks)

    def candidates(self, words: np.ndarray, stride: int) -> list[tuple[int, int]]:
        """(passage, item): the passages in which a run of ``share`` rare words of an item begins."""
        at = np.flatnonzero(self.marks[words & np.uint32(len(self.marks) - 1)])
        if not len(at):
            return []
        slot = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        same = self.words[slot] == words[at]
        at, slot = at[same], slot[same]
        count = self.first[slot + 1] - self.first[slot]
        item = self.items[np.repeat(self.first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        end = np.arange(len(at)) + self.share[item] - 1
        last = np.minimum(end, len(at) - 1)
        runs = (end < len(at)) & (item[last] == item) & (at[last] - at < self.sizes[item] + 2 * stride)
        final = max(-(-len(words) // stride) - 2, 0)
        return sorted(set(zip(np.minimum(at[runs] // stride, final).tolist(), item[runs].tolist())))


def sparse_passages(words: np.ndarray, idf: np.ndarray, stride: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, weight) of each passage, of unit length."""
    out = []
    for i in range(0, max(len(words) - stride, 1), stride):
        at, counts = np.unique(words[i : i + 2 * stride] & np.uint32(len(idf) - 1), return_counts=True)
        x = counts * idf[at]
        if (norm := float(np.sqrt(x @ x))) > 0:
            out.append((at, (x / norm).astype(np.float32)))
    return out


def orthonormal(a: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The orthonormal factor of a QR of ``a``, from those of blocks of rows: only a block is held in double precision, and as float32 the rest."""
    starts = range(0, len(a), max(rows, a.shape[1]))
    parts = [np.linalg.qr(a[i : i + starts.step]) for i in starts]
    turn = np.linalg.qr(np.concatenate([r for _, r in parts]).astype(np.float64))[0]
    out, at = np.empty((len(a), turn.shape[1]), np.float32), 0
    for i, (q, _) in zip(starts, parts):
        out[i : i + starts.step] = q @ turn[at : at + q.shape[1]]
        at += q.shape[1]
    return out


def randomised_svd(rows: DataFrame, idf: np.ndarray, stride: int, rank: int, *, extra: int = 8, rounds: int = 1, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (buckets x rank) of the leading right singular vectors of the passages of ``rows`` (struct weight, words).

    Each round multiplies by A'A: tasks add up their passages' share, Spark the tasks'; the driver orthonormalises a matrix of
    fixed size.
    """
    rng, basis = np.random.default_rng(seed), np.empty((len(idf), rank + extra), np.float32)
    for i in range(0, len(basis), 4096):  # the driver's memory is short
        basis[i : i + 4096] = rng.normal(size=basis[i : i + 4096].shape)
    basis = orthonormal(basis)
    for _ in range(rounds + 1):

        def add(total: np.ndarray, values: list, basis: np.ndarray = basis) -> None:
            for v in values:
                for at, x in sparse_passages(np.frombuffer(v["words"], np.uint32), idf, stride):
                    total[at] += np.outer(x * v["weight"], x @ basis[at])

        product, n = summed(rows, add, basis.shape, np.float32)
        if not n:
            return basis[:, :rank]
        last, basis = basis, orthonormal(product)
    values, turn = np.linalg.eigh((last.T @ product).astype(float))
    order = np.argsort(-values)[:rank]
    return np.ascontiguousarray((last @ turn)[:, order].astype(np.float32))


def _scan(words: np.ndarray, latent: Latent, items: list[dict], queries: np.ndarray, owner: np.ndarray, rare: RareWords, *, cosine: float, overlap: float, chunk: int = 8192) -> Iterator[tuple[int, float, float]]:
    """(item index, cosine, overlap) of the items that a text holds."""
    best: dict[int, tuple[float, float]] = {}
    stride = latent.stride
    seeds: dict[int, list[tuple[int, int]]] = {}
    for p, item in rare.candidates(words, stride):
        seeds.setdefault(p * stride // chunk, []).append((p, item))
    for start in range(0, max(len(words) - stride, 1), chunk):
        part = words[start : start + chunk + stride]
        passages = latent.passages(part)
        norms = np.maximum(np.linalg.norm(passages, axis=1), 1e-9)
        near = passages @ queries.T
        where, which = np.nonzero(near > cosine * norms[:, None])
        tried: set[tuple[int, int]] = set()
        pairs = [(p, int(owner[q]), q) for p, q in zip(where.tolist(), which.tolist())]
        pairs += [(p - start // stride, item, -1) for p, item in seeds.get(start // chunk, ())]
        for p, item, q in pairs:
            n = len(items[item]["words"])
            if best.get(item, (0, 0))[1] == 1 or (p, item) in tried:
                continue
            tried.add((p, item))
            middle = start + p * stride
            around = words[max(0, middle - n) : middle + 2 * stride + n]
            found = common_length(items[item]["places"], n, around) / n
            answer = items[item]["answer"]
            if found >= overlap and (answer is None or common_subsequence(answer, words[max(0, middle - 4 * n) : middle + 2 * stride + 4 * n]) == len(answer)):
                score = float((near[p, q] if q >= 0 else near[p, owner == item].max()) / norms[p])
                best[item] = max(best.get(item, (0.0, 0.0)), (score, found), key=lambda v: v[::-1])
    yield from ((i, *v) for i, v in best.items())


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, *, answer: str | None = None, stride: int = 16, bits: int = 15, rank: int = 128, cosine: float = 0.72, overlap: float = 0.75, rare_words: bool = True, max_fit_docs: int = 4000, block_items: int = 2000, seed: int = 11) -> DataFrame:
    """doc_id, item_id, cosine, overlap: the items that each document holds; documents that hold none have no row.

    ``overlap`` is the share of an item's words, A-Z lower-cased and without ASCII signs, that the longest common subsequence
    with the text around a candidate must have; ``answer`` names a column of the benchmark whose words must be near as well (a
    null or empty answer asks for nothing). ``cosine`` is a floor for candidates of the latent search only; items found by their
    rare words can have less, and without ``rare_words`` there is the latent search alone. The index is fitted on ``max_fit_docs`` documents at most; every passage of every
    document is searched. Null or empty texts and items hold nothing. Items with a null id are found like any other; documents
    with a null doc_id give rows with a null doc_id. Repeated rows of a document give one row an item. Only doc_id, text,
    item_id, text and the answer are read. No documents or no items give no rows.
    """
    hashes = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(lambda t: (word_hashes(t).tobytes(),), HASHES), "doc_id long, words binary"), "hashes")
    size = 1 << bits

    def seen(total: np.ndarray, values: list) -> None:
        for v in values:
            total[np.unique(np.frombuffer(v, np.uint32) & np.uint32(size - 1))] += 1

    counts, n = summed(hashes.select("words"), seen, (size,), np.int64)
    idf = np.log((2 + n) / (1 + counts)).astype(np.float32)
    sample = bounded_sample(hashes.filter("doc_id is not null and length(words) > 0"), max_fit_docs, seed).select("words")
    total = benchmark.count()
    blocks = max(1, -(-total // block_items))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # block_items rows or so
        items = [{"id": r["item_id"], "words": word_hashes((r["text"] or "").encode()), "answer": word_hashes(r["answer"].encode()) if r["answer"] else None} for r in block]
        items = [i for i in items if len(i["words"])]
        one = _block(hashes, sample, items, idf, stride=stride, rank=rank, cosine=cosine, overlap=overlap, rare_words=rare_words)
        found = one if found is None else found.unionAll(one)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "cosine")).alias("b")).select("doc_id", "item_id", "b.cosine", "b.overlap")


def _block(hashes: DataFrame, sample: DataFrame, items: list[dict], idf: np.ndarray, *, stride: int, rank: int, cosine: float, overlap: float, rare_words: bool) -> DataFrame:
    ddl = "doc_id long, item_id long, cosine double, overlap double"
    spark = hashes.sparkSession
    if not items:
        return spark.createDataFrame([], ddl)
    bench = spark.createDataFrame([(i["words"].tobytes(),) for i in items], "words binary")
    passages = lambda t: t.select(F.sum(F.greatest(F.length("words") / (4 * stride) - 1, F.lit(1)))).first()[0] or 0
    even = float(passages(sample) / max(passages(bench), 1)) or 1.0
    rows = sample.select(F.struct(F.lit(1.0).alias("weight"), "words").alias("row")).unionAll(bench.select(F.struct(F.lit(max(even, 1.0)).alias("weight"), "words").alias("row")))
    basis = randomised_svd(staged(rows.coalesce(4), "fit").select("row"), idf, stride, rank)
    latent = Latent(idf, basis * idf[:, None], stride)
    items = [i | {"places": places(i["words"])} for i in items]
    rare = RareWords.of(items if rare_words else [], idf, overlap)
    made = [latent.passages(i["words"]) for i in items]
    owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(made)])
    queries = np.concatenate(made)
    queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    ids = [i["id"] for i in items]
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = [(d, ids[i], c, o) for d, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if w for i, c, o in _scan(np.frombuffer(w, np.uint32), latent, items, queries, owner, rare, cosine=cosine, overlap=overlap)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return hashes.mapInArrow(run, ddl)
