"""Operator 1, BPE encoding and decoding with tree concatenation for long unsplit text.

Texts up to ``piece_chars`` are encoded where they lie, without a shuffle. A longer text is cut into pieces that different tasks
encode in parallel:

* between a non-space and an ASCII space, where the pre-tokenizer always cuts, so the pieces' ids simply follow each other;
* a stretch without such a place is cut at the pre-tokenizer's own matches;
* a single match longer than a piece is *unsplit*: its slices are encoded apart and joined as a tree. Each join re-encodes a
  window of tokens around the seam and doubles it until the first and the last token of the window are the ones both sides
  have there. Byte-pair encodings whose neighbouring tokens all are what the encoder makes of that pair are the encoder's own
  output, so such a join is exact; at worst the window is both whole sides.

The vocabulary is read once on the driver (a fixed size) and travels with the task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.words import binary, small

#: The pre-tokenizer of byte-level vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
IDS_DDL = "doc_id long, n_tokens long, ids binary"


def _printable() -> dict[str, int]:
    """The byte of each printable stand-in of byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and special tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _printable()
        if spec.get("normalizer") or model.get("ignore_merges") or model["type"] != "BPE":
            raise ValueError("a byte-level BPE model without normalizer is needed")
        cutter = spec.get("pre_tokenizer") or {}
        if any(c.get("add_prefix_space") for c in [cutter, *cutter.get("pretokenizers", [])]) or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("prefix spaces and stripping or whole-word special tokens are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        made = [self.ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of the merges")

    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)


def join_ids(left: list[int], right: list[int], coder: tiktoken.Encoding) -> list[int]:
    """Ids of one pre-token from the ids of its two parts: a window around the seam grows until both sides agree."""
    k = 4
    while True:
        a, b = left[max(0, len(left) - k) :], right[:k]
        window = coder._encode_single_piece(coder.decode_bytes(a + b)) if a or b else []
        ends = len(a) == len(left) or window[0] == a[0], len(b) == len(right) or window[-1] == b[-1]
        if all(ends):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def tree(parts: list[list[int]], coder: tiktoken.Encoding) -> list[int]:
    """Neighbours are joined in rounds until one list is left."""
    while len(parts) > 1:
        parts = [join_ids(*parts[i : i + 2], coder) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cut(text: str, size: int, special: list[str]) -> Iterator[tuple[int, str]]:
    """(unsplit, piece): pieces of at most about ``size`` characters; ``unsplit`` numbers the long pre-token of a slice, else -1."""
    at, n_unsplit = 0, 0
    literal = regex.compile("|".join(map(regex.escape, special))) if special else None
    while at < len(text):
        end = _safe(text, at, min(at + size, len(text)), size)
        if end - at <= size:
            yield -1, text[at:end]
        else:
            held: list[str] = []
            for token in _matches(text[at:end], literal):
                if held and sum(map(len, held)) + len(token) > size:
                    spaces: list[str] = []
                    while held and held[-1].isspace():
                        spaces.insert(0, held.pop())
                    if held:
                        yield -1, "".join(held)
                    for space in spaces:  # alone, two of them could become one pre-token
                        yield n_unsplit, space
                        n_unsplit += 1
                    held = []
                if len(token) > size and token not in special:
                    for i in range(0, len(token), size):
                        yield n_unsplit, token[i : i + size]
                    n_unsplit += 1
                else:
                    held.append(token)
            if held:
                yield -1, "".join(held)
        at = end


def _safe(text: str, at: int, end: int, size: int) -> int:
    """The last place up to ``end``, or else the first after it, between a non-space and an ASCII space; the text's end otherwise."""
    if end == len(text):
        return end
    p = end
    while (p := max(text.rfind(" ", at + 1, p), text.rfind("\n", at + 1, p))) > at:
        if not text[p - 1].isspace():
            return p
    found = regex.compile(r"\S[ \n]").search(text, end - 1)
    while found and text[found.start()].isspace():
        found = regex.compile(r"\S[ \n]").search(text, found.start() + 1)
    return found.start() + 1 if found else len(text)


def _matches(text: str, literal: regex.Pattern | None) -> Iterator[str]:
    pattern, at = regex.compile(PATTERN), 0
    for m in literal.finditer(text) if literal else ():
        yield from pattern.findall(text[at : m.start()])
        yield m[0]
        at = m.end()
    yield from pattern.findall(text[at:])


def _text(ids: np.ndarray, coder: tiktoken.Encoding) -> str:
    return coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def _coded_batch(doc_ids: pa.Array, ids: list[np.ndarray], coder: tiktoken.Encoding, with_text: bool) -> pa.RecordBatch:
    columns = [doc_ids.cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
    if with_text:
        columns.append(pa.array([_text(x, coder) for x in ids], pa.string()))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([*IDS, *([("text", pa.string())] if with_text else [])]))


def encode(docs: DataFrame, vocab_path: str, *, piece_chars: int = 32_768, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each whole text; special tokens in a text get their id.

    The ids are those of the tokenizers library with ``add_special_tokens=False``. ``with_text`` adds the text decoded from the
    ids in the same task, as ``decode`` makes it. A null text counts as empty and has no ids. Rows with a null or repeated
    doc_id each give a row. Only doc_id and text are read. No rows give no rows.
    """
    vocab = Vocabulary(vocab_path)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids_ddl = IDS_DDL + ", text string" * with_text

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocab.encoding()
        for batch in small(batches):
            yield _coded_batch(batch.column(0), [coder.encode_to_numpy(t, allowed_special="all") for t in batch.column(1).to_pylist()], coder, with_text)

    cut_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("unsplit", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 16):
            for d, h, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made = list(cut(t, piece_chars, list(vocab.special)))
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "text_hash": h, "at": i, "unsplit": u, "piece": p} for i, (u, p) in enumerate(made)], schema=cut_schema)

    coded_schema = pa.schema([*list(cut_schema)[:4], ("ids", pa.binary())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocab.encoding()
        for batch in small(batches, 16):
            ids = [coder.encode_to_numpy(p, allowed_special="all") if u < 0 else np.array(coder._encode_single_piece(p), "<u4") for u, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema=coded_schema)

    def joined(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocab.encoding()
        for batch in groups:
            out = []
            for parts in batch.column(1).to_pylist():
                copies = sum(1 for r in parts if r["at"] == 0)  # a repeated document gave every piece as often
                out.append((copies, _joined(parts[::copies], coder)))
            doc_ids = batch.column(0).take(pa.array([i for i, (n, _) in enumerate(out) for _ in range(n)], pa.int64()))
            yield _coded_batch(doc_ids, [ids for n, ids in out for _ in range(n)], coder, with_text)

    short = rows.filter(F.length("text") <= piece_chars).mapInArrow(whole, ids_ddl)
    long = rows.filter(F.length("text") > piece_chars).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    cuts = long.mapInArrow(pieces, "doc_id long, text_hash long, at long, unsplit long, piece string")
    parts = cuts.repartition("doc_id", "text_hash", "at").mapInArrow(coded, "doc_id long, text_hash long, at long, unsplit long, ids binary")
    gathered = parts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("at", "unsplit", "ids"))).alias("parts"))  # one document
    return short.unionAll(gathered.select("doc_id", "parts").mapInArrow(joined, ids_ddl))


def _joined(parts: list[dict], coder: tiktoken.Encoding) -> np.ndarray:
    """The ids of a document from those of its pieces in order."""
    done: list[np.ndarray] = []
    slices: list[list[int]] = []
    for i, p in enumerate(parts):
        ids = np.frombuffer(p["ids"], "<u4")
        if p["unsplit"] < 0:
            done.append(ids)
            continue
        slices.append(ids.tolist())
        if i + 1 == len(parts) or parts[i + 1]["unsplit"] != p["unsplit"]:
            done.append(np.array(tree(slices, coder), "<u4"))
            slices = []
    return np.concatenate(done)


def decode(encoded: DataFrame, vocab_path: str, *carry: str) -> DataFrame:
    """doc_id, text and the ``carry`` columns: the texts of ``ids``, special tokens included; broken UTF-8 becomes U+FFFD. Null ids give null."""
    vocab = Vocabulary(vocab_path)
    rows = encoded.select("doc_id", "ids", *carry)
    schema = rows.schema

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocab.encoding()
        for batch in small(batches):
            texts = [None if b is None else _text(np.frombuffer(b, "<u4"), coder) for b in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["doc_id", "text", *carry])

    ddl = ", ".join(["doc_id long", "text string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[2:])])
    return rows.mapInArrow(back, ddl)
