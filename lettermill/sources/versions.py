"""Stored results by key and data version, with an atomic switch and retention of the newest ones; notes that make a batch count.

A result is written under a name of its own that nobody knows yet. Then a manifest entry, a file of a few bytes, is moved into
place: from that moment, and not before, readers see the version, and a job that dies leaves none. Entries sort by the order in which
they were published. Retention drops entries first and their data only ``grace_seconds`` later, so a reader that has looked up a
version can finish. Everything lies in a folder that all executors share; nothing is kept in memory.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: How many results are kept (fixed value).
KEEP = 500


@dataclass(frozen=True)
class Entry:
    key: str
    version: str
    place: str
    at: float
    file: str


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _put(store: fs.FileSystem, path: str, data: dict) -> None:
    """Writes a small file beside its place and moves it there, over an older one."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    made = f"{path}.{uuid.uuid4().hex}.new"
    with store.open_output_stream(made) as f:
        f.write(json.dumps(data).encode())
    store.move(made, path)


def put_note(root: str, number: int, data: dict) -> None:
    """The note of a number under ``root``, all at once."""
    store, base = _store(root)
    _put(store, f"{base}/notes/{number:020d}.json", data)


def get_notes(root: str) -> dict[int, dict]:
    store, base = _store(root)
    out = {}
    for info in store.get_file_info(fs.FileSelector(f"{base}/notes", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                out[int(info.base_name[:-5])] = json.loads(f.read())
    return out


def folder_names(path: str) -> list[str]:
    store, base = _store(path)
    return [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]


def drop_folder(path: str) -> None:
    """Deletes a folder or a file."""
    store, base = _store(path)
    (store.delete_file if store.get_file_info(base).type == fs.FileType.File else store.delete_dir)(base)


def entries(root: str) -> list[Entry]:
    """The published results of ``root``, oldest first: ``KEEP`` small files or so."""
    store, base = _store(root)
    out = []
    for info in store.get_file_info(fs.FileSelector(f"{base}/manifest", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            try:
                with store.open_input_stream(info.path) as f:
                    out.append(Entry(**json.loads(f.read()), file=info.path))
            except FileNotFoundError:  # expired meanwhile
                continue
    return sorted(out, key=lambda e: e.file)


def lookup(root: str, key: str, version: str) -> str | None:
    """Where the data of this key and version lie, if they are published."""
    return next((e.place for e in reversed(entries(root)) if (e.key, e.version) == (key, version)), None)


def newest(root: str) -> dict[str, Entry]:
    """The last entry of each key."""
    return {e.key: e for e in entries(root)}


def supersede(root: str, key: str) -> None:
    """Drops the entries of a key before its last; their data go when ``expire`` finds them old enough."""
    store, _ = _store(root)
    for e in [e for e in entries(root) if e.key == key][:-1]:
        store.delete_file(e.file)


def new_place(root: str) -> str:
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def publish(root: str, key: str, version: str, place: str) -> None:
    """Makes written data the result of this key and version, in one step."""
    store, base = _store(root)
    _put(store, f"{base}/manifest/{time.time_ns():020d}-{uuid.uuid4().hex}.json", {"key": key, "version": version, "place": place, "at": time.time()})


def expire(root: str, *, keep: int = KEEP, grace_seconds: float = 3600) -> int:
    """Drops all but the newest ``keep`` entries; returns how many went. Data that no entry names go once they are ``grace_seconds`` old."""
    store, base = _store(root)
    gone = entries(root)[:-keep] if keep else entries(root)
    for e in gone:
        store.delete_file(e.file)
    named = {e.place.rsplit("/", 1)[-1] for e in entries(root)}
    for info in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)):
        if info.base_name not in named and info.mtime is not None and time.time() - info.mtime.timestamp() >= grace_seconds:
            store.delete_dir(info.path)
    return len(gone)


def materialised(spark: SparkSession, root: str, key: str, version: str, compute: Callable[[], DataFrame], *, keep: int = KEEP, grace_seconds: float = 3600) -> DataFrame:
    """The stored result of ``compute`` for this key and data version: computed once, read afterwards; the newest ``keep`` stay.

    Two jobs that compute the same version at once both publish the same rows; readers take either. A null result table is stored
    like any other: an empty one stays empty.
    """
    place = lookup(root, key, version)
    if place is None:
        place = new_place(root)
        compute().write.parquet(place)
        publish(root, key, version, place)
        expire(root, keep=keep, grace_seconds=grace_seconds)
    return spark.read.parquet(place)
