"""Operator 11, fill-in-the-middle: a text becomes prefix, suffix and middle between marks, in one pass of pyarrow.compute a batch.

A batch's texts are split into units (lists that share the batch's own bytes), flattened with parent indices, numbered within their
parent, filtered by role (prefix, middle, suffix), rebuilt as lists and put together by ``binary_join``; the pieces and marks meet
in ``binary_join_element_wise``. There is no shuffle. Rows are taken ``block_bytes`` of text at a time, and a longer text goes
through in blocks of whole units, so a task never holds the unit lists of more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
Pieces = list[pa.Array]


def _starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit: a code point, a word with the white space after it, or a line with its \\n."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    ends = _WHITE[data] if unit == "word" else data == 10
    begins = np.zeros(len(data), bool)
    begins[1:] = ends[:-1] & ~ends[1:] if unit == "word" else ends[:-1]
    return begins


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large string array, without a copy."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def unit_lists(texts: pa.Array, unit: str = "char") -> pa.LargeListArray:
    """The units of each text, as lists over the texts' own bytes."""
    data, at = _bytes_of(texts)
    begins = _starts(data, unit)
    begins[at[:-1][at[1:] > at[:-1]]] = True
    first = np.flatnonzero(begins)
    values = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(first, at)), values)


def by_role(units: pa.LargeListArray, low: np.ndarray, high: np.ndarray) -> Pieces:
    """The joined units of each list before ``low``, from there to ``high``, and after."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    offsets = units.offsets.to_numpy()
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(pa.array(offsets[:-1] - offsets[0]), parent))
    past = [pc.greater_equal(ordinal, pc.take(pa.array(cut), parent)).cast(pa.int8()) for cut in (low, high)]
    role = pc.add(*past)
    out = []
    for k, held in enumerate((low, high - low, np.diff(offsets) - high)):
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)])), flat.filter(pc.equal(role, k)))
        out.append(pc.binary_join(lists, pa.scalar("", pa.large_string())))
    return out


def _of_long(text: pa.Array, low: int, high: int, unit: str, block_bytes: int) -> Pieces:
    """``by_role`` of one text, a block of whole units at a time."""
    data, _ = _bytes_of(text)
    begins = np.flatnonzero(_starts(data, unit))
    cuts = np.unique(np.concatenate([[0], begins[np.searchsorted(begins, np.arange(block_bytes, begins[-1] + 1, block_bytes))] if len(begins) else [], [len(data)]]).astype(np.int64))
    parts: list[Pieces] = []
    done = 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        block = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, b - a], np.int64)), pa.py_buffer(data[a:b]))
        units = unit_lists(block, unit)
        n = len(units.values)
        parts.append(by_role(units, *(np.clip([x - done], 0, n).astype(np.int64) for x in (low, high))))
        done += n
    one = lambda role: pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), pa.concat_arrays([p[role] for p in parts]))
    return [pc.binary_join(one(role), pa.scalar("", pa.large_string())) for role in range(3)]


def _pieces(texts: pa.Array, low: np.ndarray, high: np.ndarray, unit: str, block_bytes: int) -> Pieces:
    data, at = _bytes_of(texts)
    if len(texts) == 1 and len(data) > block_bytes:
        return _of_long(texts, int(low[0]), int(high[0]), unit, block_bytes)
    return by_role(unit_lists(texts, unit), low, high)


def rebuilt(output: pa.Array, form: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The text that an output of the given form was made from."""
    p, s, m = marks
    halves = lambda x, mark: [pc.list_element(pc.split_pattern(x, mark, max_splits=1), i) for i in (0, 1)]
    for name, first, second, order in (("psm", p, s, 1), ("spm", s, p, -1)):
        rows = pc.equal(form, name)
        head, middle = halves(output.filter(rows), m)
        before, after = halves(pc.utf8_slice_codeunits(head, len(first)), second)[::order]
        output = pc.replace_with_mask(output, rows, pc.binary_join_element_wise(before, middle, after, pa.scalar("", output.type)))
    return output


def _checked(marks: tuple[str, str, str]) -> None:
    for a in marks:
        for b in marks:
            if not a or any(a[-k:] == b[:k] for k in range(1, len(a))) or (a in b and (a != b or marks.count(a) > 1)):
                raise ValueError(f"marks must differ, none within another, and never overlap: {marks}")


def _byte_slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``most`` bytes of text, or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def fill_middle(docs: DataFrame, *, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, unit: str = "char", marks: tuple[str, str, str] = MARKS, block_bytes: int = 1 << 20, with_restored: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output and, if asked, restored: a row for each row of ``docs``.

    The first four 8-digit groups h1 to h4 of the hexadecimal sha256 of ``seed:doc_id`` decide. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if it is empty, holds a mark, or
    h3 % 100 >= ``fim_percent``; otherwise its form is spm if h4 % 100 < ``spm_percent``, else psm. Marks p, s, m give
    psm = p prefix s suffix m middle and spm = s suffix p prefix m middle. ``unit``: char (code points), word (with the white space
    after it) or line; the units of a text always make up the whole text. ``rebuilt`` gets the text back from output and form, which
    is why marks must not overlap (raises ``ValueError``).

    A null text counts as empty: plain, output empty, n 0. A null doc_id hashes as an empty string. Repeated rows give equal rows.
    Texts of any length are taken whole, ``block_bytes`` at a time. prefix_units and middle_units are null for plain rows. Only
    doc_id and text are read, so other columns cannot clash. No rows give no rows.
    """
    _checked(marks)
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit is char, word or line, not {unit}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.large_string())]
    schema = pa.schema([*kinds, *([("restored", pa.large_string())] if with_restored else [])])
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    none = pa.scalar("", pa.large_string())

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        data, at = _bytes_of(texts)
        begins = _starts(data, unit)
        begins[at[:-1][at[1:] > at[:-1]]] = True
        n = np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
        draw = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
        cuts = np.sort(np.stack([draw[0] % (n + 1), draw[1] % (n + 1)]), axis=0)
        marked = pc.or_kleene(pc.or_kleene(pc.match_substring(texts, marks[0]), pc.match_substring(texts, marks[1])), pc.match_substring(texts, marks[2])).to_numpy(zero_copy_only=False)
        plain = (n == 0) | marked | (draw[2] % 100 >= fim_percent)
        spm = ~plain & (draw[3] % 100 < spm_percent)
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
        output = texts
        if not plain.all():
            cut = pa.array(~plain)
            before, middle, after = _pieces(texts.filter(cut), *(c[~plain] for c in cuts), unit, block_bytes)
            swap = pa.array(spm[~plain])
            joined = pc.binary_join_element_wise(pc.if_else(swap, s, p), pc.if_else(swap, after, before), pc.if_else(swap, p, s), pc.if_else(swap, before, after), m, middle, none)
            output = pc.replace_with_mask(texts, cut, joined)
        columns = [batch.column("doc_id"), pa.array(n), form, *(pa.array(x, mask=plain) for x in (cuts[0], cuts[1] - cuts[0])), output]
        return pa.RecordBatch.from_arrays([*columns, *([rebuilt(output, form, marks)] if with_restored else [])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.set_column(1, "text", batch.column(1).cast(pa.large_string()))
            for part in _byte_slices(wide, pc.binary_length(wide.column(1)).to_numpy(), block_bytes):
                yield made(part)

    ddl = "doc_id long, n long, form string, prefix_units long, middle_units long, output string" + ", restored string" * with_restored
    return rows.mapInArrow(run, ddl)
