"""Benchmark decontamination by Wu-Manber search for many word patterns at once.

A pattern is a window of benchmark words. Patterns of one length form a
matcher with the tables of Wu and Manber: the shift table tells for a block of
words how far a window may move without passing an occurrence; where it says
zero, the bucket of patterns that end in that block is looked up, the first
block of each (its prefix) is compared, and direct comparison of all words
confirms an occurrence.

The benchmark is read in blocks of bounded size. A block's tables go to the
executors, every document passes it, what was found is written, and the tables
are destroyed before the next block's go out: an executor holds one block at a
time, the driver the one to come, and no join between documents and windows is
ever made.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, map_rows, materialize, table

WINDOW = 10
#: Patterns in one block of the benchmark (a few hundred bytes each).
BLOCK_PATTERNS = 200_000


class Matcher:
    """Wu-Manber tables for patterns of ``m`` words each; a block is two words (one if m is 1)."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], tuple]):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.b, m + 1):
                key = self.key(words, end - self.b)
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.bucket[self.key(words, m - self.b)].append((words[0], list(words), items))

    def key(self, words, at: int):
        return words[at] if self.b == 1 else (words[at], words[at + 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """Starts of occurrences and the items they belong to."""
        m, n, shift, default = self.m, len(words), self.shift.get, self.default
        at = m - self.b  # start of the block that ends the window
        last = n - self.b
        two = self.b == 2
        while at <= last:
            key = (words[at], words[at + 1]) if two else words[at]
            skip = shift(key, default)
            if skip:
                at += skip
                continue
            start = at - m + self.b
            first, window = words[start], None
            for prefix, pattern, items in self.bucket[key]:
                if prefix == first:
                    if window is None:
                        window = words[start : start + m]
                    if window == pattern:
                        yield start, items
            at += 1


def windows(item_id: int, text: bytes | None, size: int) -> Iterator[tuple[bytes, ...]]:
    """Every window of an item; an item of fewer words, but not none, is one window."""
    words = alnum_words(text)
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


def blocks(items: Iterable[tuple[int, bytes | None]], size: int, limit: int) -> Iterator[list[Matcher]]:
    """Matchers for successive blocks of the benchmark, of ``limit`` patterns at most."""
    held: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    count = 0
    build = lambda: [Matcher(m, {k: tuple(v) for k, v in p.items()}) for m, p in sorted(held.items())]
    for item_id, text in items:
        for w in windows(item_id, text, size):
            if count >= limit and w not in held[len(w)]:
                yield build()
                held.clear()
                count = 0
            count += w not in held[len(w)]
            held[len(w)][w].add(item_id)
    if count:
        yield build()


def hits(words: list[bytes], matchers: list[Matcher]) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges (start, end exclusive; not merged) and the items found."""
    ranges, items = [], set()
    for m in matchers:
        for start, found in m.search(words):
            ranges.append((start, start + m.m))
            items.update(found)
    return ranges, items


def merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
STATE = "n_words long, ranges array<struct<start:int,end:int>>, items array<long>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_patterns: int = BLOCK_PATTERNS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, ranges (merged hit word ranges), items (ids found, ascending).

    Null and empty texts have no words and no hits; so has everything if the
    benchmark is empty or has only such items. An item without an id is left
    out. Repeated rows, on either side, count as they stand. Other columns are
    ignored.
    """
    source = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string").cast("binary"))
    rows = ((r[0], None if r[1] is None else bytes(r[1])) for r in source.toLocalIterator())
    state = as_bytes(docs, id_col, text_col).select("_id", "_text", *(F.lit(None).cast(t).alias(n) for n, t in (("n_words", "long"), ("ranges", "array<struct<start:int,end:int>>"), ("items", "array<long>"))))
    between, at_last = f"_id long, _text binary, {STATE}", f"_id long, {STATE}"
    found = in_turn(state, blocks(rows, window, block_patterns), lambda tables, last: lambda batch: scan(batch, tables.value, last), between, at_last)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "ranges", "items")


def in_turn(df: DataFrame, some_blocks: Iterator[list[Matcher]], make, schema, at_last) -> DataFrame:
    """``df`` after each block's function in turn; ``make`` gets a broadcast block and whether it is the last.

    The result of all but the last block has ``schema`` and is written before
    the next goes out; that of the last has ``at_last``.
    """
    sc, held = df.sparkSession.sparkContext, next(some_blocks, [])
    while True:
        tables, held = sc.broadcast(held), next(some_blocks, None)
        last = held is None
        out = map_rows(df, lambda tables=tables, last=last: make(tables, last), at_last if last else schema)
        if last:
            return out
        df = materialize(out, "searched")
        tables.destroy()


def scan(batch: pa.RecordBatch, matchers: list[Matcher], last: bool) -> pa.RecordBatch:
    """Words, ranges and items of each text, added to those of earlier blocks; texts go on only to a next block."""
    old_ranges, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
    counts, ranges, items = [], [], []
    for text, was, had in zip(batch.column(1), old_ranges, old_items):
        words = alnum_words(text.as_py())
        found, ids = hits(words, matchers)
        counts.append(len(words))
        ranges.append([{"start": a, "end": b} for a, b in merge([*((x["start"], x["end"]) for x in was or ()), *found])])
        items.append(sorted(ids.union(had or ())))
    columns = {"_id": batch.column(0), "_text": batch.column(1), "n_words": pa.array(counts, pa.int64()), "ranges": pa.array(ranges, pa.list_(RANGE)), "items": pa.array(items, pa.list_(pa.int64()))}
    if last:
        del columns["_text"]
    return pa.RecordBatch.from_pydict(columns)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_patterns: int = BLOCK_PATTERNS, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay.

    Null and empty texts hold none and stay, as does everything if the
    benchmark is empty; an item without an id is left out. Repeated rows are
    judged each; columns may have any names.
    """
    source = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("binary"))
    rows = ((r[0], None if r[1] is None else bytes(r[1])) for r in source.toLocalIterator())
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch, tables) -> pa.RecordBatch:
        texts = (t.as_py() for t in batch.column(at).cast(pa.binary()))
        return batch.filter(pa.array([next((False for m in tables.value for _ in m.search(w)), True) for w in map(alnum_words, texts)], pa.bool_()))

    return in_turn(docs, blocks(rows, window, block_patterns), lambda tables, last: lambda batch: keep(batch, tables), docs.schema, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS win
       FROM (SELECT doc_id, m, w, unnest(range(len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, p.m, p.item_id FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
