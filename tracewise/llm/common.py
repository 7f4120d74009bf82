"""Shared folders, Arrow row plumbing and text splitting for the operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import hinted, materialize, scratch, shared_dir, table  # noqa: F401

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that are not part of a letter-or-digit word become spaces, A-Z become a-z.
_ALNUM = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters.

    Every delimiter is ASCII, so working on UTF-8 bytes gives the same words
    as working on characters.
    """
    return (text or b"").translate(_ALNUM).split()


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
    return (text or b"").lower().split()


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until it is none of ``columns`` (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns ``_id`` and ``_text`` (UTF-8 bytes, null for null)."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))


#: Arrow batches are worked on in parts of about this size, which bounds what a Python worker holds beside the batch.
PART_BYTES = 8 << 20


def tidy() -> None:
    """Gives memory that this worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that is built once in each task.

    If the function has an attribute ``close``, that is called at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        getattr(step, "close", int)()
        tidy()

    return df.mapInArrow(run, schema)


def grouped(column: pa.Array, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts of an Arrow column (null: empty), in lists of about ``size`` bytes."""
    held, total = [], 0
    for v in column:
        held.append(v.as_py() or b"")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


class BoundedCache:
    """Values of words, in two generations of ``limit`` entries at most.

    When the young one is full it becomes the old one; words still in use move
    back, words seen once fade away.
    """

    def __init__(self, fill: Callable[[list[bytes]], list], limit: int = 200_000):
        self.fill, self.limit = fill, limit
        self.clear()

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def prepare(self, words: set[bytes]) -> dict:
        """A table that holds every word of ``words``, good until the next call."""
        new = words.difference(self.young)
        if not new:
            return self.young
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, words
        known = self.old.keys() & new
        self.young.update(zip(known, map(self.old.__getitem__, known)))
        missing = list(new - known)
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            self.young.update(zip(part, self.fill(part)))
        return self.young
