"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents are tokenized on the executors, cut at the capacity, and packed by
bulk-synchronous best-fit. Pieces and gaps are tables of rows. Pieces of more
than half the capacity begin a sequence each. Then, band by band of falling
lengths, a superstep range-sorts the band's pieces and the open gaps, deals both
to parts by rank, so that every part sees the same mix of lengths and of gaps,
and sweeps every part from large to small: a piece takes its successor, the
tightest gap that holds it; of pieces that want the same gap, the first by rank
has it and the others go on to the next. The remainders are the gaps of the next
superstep, sorted and dealt anew. A last superstep sweeps what the smallest band
left over. The driver sees counts of rows only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, as_bytes, grouped, map_rows, materialize, table, tidy

CAPACITY = 2048
#: Pieces and gaps that one part of a superstep holds, about.
PART_ROWS = 100_000
#: Supersteps, by the largest length of their pieces as a share of the capacity.
BANDS = (1 / 2, 1 / 3, 1 / 8, 1 / 32)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = f"{PIECES}, _row long, sequence_id long, offset long, kind int"
#: Kinds of rows: a placed piece, a gap (``_row`` its sequence, ``length`` its room), a piece that found no gap.
PLACED, GAP, LEFT = 0, 1, 2


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin() -> tuple[re.Pattern, bytes]:
    """The tokenizer's split and lower-casing, for texts of Latin-1 characters.

    Such texts are in normal form, and each character is a byte.
    """
    kinds = {c: [chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == c] for c in "LN"}
    letters, numbers = (re.escape("".join(kinds[c])) for c in "LN")
    parts = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0d \\x85\\xa0{letters}{numbers}]+"
    lower = [chr(i).lower() for i in range(256)]
    return re.compile(parts.encode("latin-1")), "".join(c if len(c) == 1 and c < "\u0100" else chr(i) for i, c in enumerate(lower)).encode("latin-1")


_PARTS, _LOWER = _latin()


class Tokens:
    """Token ids of words, packed as little-endian unsigned 32-bit integers.

    The tokenizer splits a text before it looks for tokens, so a text's ids are
    those of its parts in turn. Texts of Latin-1 characters are split exactly
    as the tokenizer does; others at white space, which it drops and never
    joins across. Both kinds have a cache of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tok.get_vocab_size(), dtype=bool)  # tokens that end a part
        self.closing[[i for piece, i in self.tok.get_vocab().items() if piece.endswith("</w>")]] = True
        self.parts = BoundedCache(self.encode_parts, limit=300_000)
        self.words = BoundedCache(lambda words: self.encode([w.decode("utf-8", "replace") for w in words]), limit=100_000)

    def clear(self) -> None:
        """Forgets all words: a task meets most of its words by itself, and workers outlive their tasks."""
        self.parts.clear()
        self.words.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """All parts are tokenized as one text and told apart by the tokens that end a part."""
        texts = [p.decode("latin-1") for p in parts]
        ids = np.asarray(self.tok.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            return self.encode(texts)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), four bytes each, without the closing id."""
        split: list[tuple[bool, list[bytes]]] = []
        for t in texts:
            try:
                if b"<|" in t:  # may spell a special token
                    raise UnicodeError
                split.append((True, _PARTS.findall((t if t.isascii() else t.decode("utf-8").encode("latin-1")).translate(_LOWER))))
            except UnicodeError:
                split.append((False, t.split()))
        tables = [c.prepare(set().union(*(w for latin, w in split if latin is kind))).__getitem__ for c, kind in ((self.words, False), (self.parts, True))]
        return [b"".join(map(tables[latin], words)) for latin, words in split]


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def packed_ids(texts: list[bytes], path: str) -> list[bytes]:
    return tokens(path).of(texts)


def piece_maker(path: str, capacity: int, end: bytes) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        ids = (x for texts in grouped(batch.column(1)) for x in packed_ids(texts, path))
        for doc_id, found in zip(batch.column(0).to_pylist(), ids):
            found += end
            for k, at in enumerate(range(0, len(found), 4 * capacity)):
                part = found[at : at + 4 * capacity]
                out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    step.close = lambda: tokens(path).clear()
    return step


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; each text is closed by id 0."""
    path, end = tokenizer or default_tokenizer_path(), b"\0\0\0\0"
    return map_rows(as_bytes(docs, id_col, text_col), lambda: piece_maker(path, capacity, end), PIECES)


def successors(lengths: list[int], rooms: list[int], capacity: int, opening: bool) -> tuple[list[int], list[int], list[int]]:
    """Places pieces, in falling order of length, each in the tightest gap that holds it.

    Returns the number of each piece's gap (-1: none) and its offset, and the
    rooms left. Gaps opened for pieces that find none, if ``opening``, come
    after the given ones. Gaps wait in a stack for each size; the sweep moves
    them to the open stack, smallest on top, when it comes down to their size.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = list(rooms)
    for k in range(len(rooms) - 1, -1, -1):
        waiting[rooms[k]].append(k)
    opened: list[int] = []
    gaps, offsets, size = [], [], capacity
    opened += waiting[capacity]
    for n in lengths:
        while size > n:
            size -= 1
            opened += waiting[size]
        if opened:
            k = opened.pop()
        elif opening:
            k = len(rooms)
            rooms.append(capacity)
        else:
            gaps.append(-1)
            offsets.append(0)
            continue
        gaps.append(k)
        offsets.append(capacity - rooms[k])
        rooms[k] = left = rooms[k] - n
        if left >= n:
            opened.append(k)
        elif left:
            waiting[left].append(k)
    return gaps, offsets, rooms


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with the part of each, dealt in turn by rank in falling order of length, so ties and copies are spread."""
    if parts == 1:
        return rows.withColumn("_part", F.lit(0).cast("long"))
    ordered = rows.repartitionByRange(parts, F.desc("length"), "_row").sortWithinPartitions(F.desc("length"), "_row")
    return ordered.withColumn("_part", F.pmod(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.lit(parts)))


def superstep(pieces_: DataFrame, gaps: DataFrame, number: int, parts: int, capacity: int, opening: bool) -> DataFrame:
    """One sweep of pieces over gaps; rows of :data:`STATE`, written."""

    def sweep(group: pa.Table) -> pa.Table:
        is_gap = group.column("kind").to_numpy() == GAP
        length, row = group.column("length").to_numpy(), group.column("_row").to_numpy()
        gap_at, piece_at = np.flatnonzero(is_gap), np.flatnonzero(~is_gap)
        gap_at, piece_at = (x[np.lexsort((row[x], -length[x]))] for x in (gap_at, piece_at))
        found, offset, rooms = successors(length[piece_at].tolist(), length[gap_at].tolist(), capacity, opening)
        base = (number << 56) | (int(group.column("_part")[0].as_py()) << 32)
        sequence = np.r_[row[gap_at], -1 - base - np.arange(len(rooms) - len(gap_at))]  # new ones have negative numbers, told apart by superstep and part
        found, room = np.asarray(found, dtype=np.int64), np.asarray(rooms, dtype=np.int64)
        own = pa.array(np.where(found >= 0, sequence[np.maximum(found, 0)] if len(sequence) else 0, 0))
        some = group.take(pa.array(piece_at))
        open_ = np.flatnonzero(room)
        none = lambda n, kind: pa.nulls(n, kind)
        n = len(open_)
        placed = [*(some.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "_row")), own, pa.array(offset, pa.int64()), pa.array(np.where(found >= 0, PLACED, LEFT).astype(np.int32))]
        left = [none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int64()), pa.array(room[open_]), none(n, pa.int64()), pa.array(sequence[open_]), none(n, pa.int64()), none(n, pa.int64()), pa.array(np.full(n, GAP, dtype=np.int32))]
        names = [c.split()[0] for c in STATE.split(", ")]
        out = pa.concat_tables([pa.table(dict(zip(names, x))) for x in (placed, left)])
        tidy()
        return out

    columns = [c.split()[0] for c in STATE.split(", ")]
    rows = dealt(pieces_, parts).select(*columns, "_part").unionByName(dealt(gaps, parts).select(*columns, "_part"))
    return materialize(rows.groupBy("_part").applyInArrow(sweep, STATE), "superstep")


def pack(found: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of :func:`pieces`.

    ``found`` has a column ``_row`` that tells its rows apart, and is written:
    it is read several times. Pieces of equal length are interchangeable;
    repeated rows take one place each. In one part the result is that of
    best-fit-decreasing; parts of ``part_rows`` rows lose a sequence each at most
    in the last superstep.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    nothing = {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}
    rows = found.withColumns({**nothing, "kind": F.lit(LEFT)})
    limits = sorted({capacity // 2, *(max(1, int(capacity * b)) for b in bands)}, reverse=True)
    band = F.lit(0)
    for k, limit in enumerate(limits):
        band = F.when(F.col("length") <= limit, k + 1).otherwise(band)
    counts = {r["band"]: r["count"] for r in found.groupBy(band.alias("band")).count().collect()}
    large = found.where(F.col("length") > limits[0]).withColumns({"sequence_id": F.col("_row"), "offset": F.lit(0).cast("long")})
    out = [large.select(*columns, "sequence_id", "offset")]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("piece", "int"), ("start", "long"))]
    gaps = large.where(F.col("length") < capacity).select(*empty, (capacity - F.col("length")).alias("length"), F.lit(None).cast("long").alias("ids_crc32"), "_row", *(v.alias(c) for c, v in nothing.items()), F.lit(GAP).alias("kind"))
    n_gaps, number = counts.get(0, 0), 0
    for k, limit in enumerate(limits):
        if not counts.get(k + 1):
            continue
        below = limits[k + 1] if k + 1 < len(limits) else 0
        some, n, last = rows.where((F.col("length") <= limit) & (F.col("length") > below)), counts[k + 1], max(counts) == k + 1
        for opening in (False, True) if last else (True,):
            if n:
                done = superstep(some, gaps, number, -(-(n + n_gaps) // part_rows), capacity, opening)
                number += 1
                out.append(done.where(F.col("kind") == PLACED).select(*columns, "sequence_id", "offset"))
                gaps, some = done.where(F.col("kind") == GAP), done.where(F.col("kind") == LEFT)
                kinds = {r["kind"]: r["count"] for r in done.groupBy("kind").count().collect()}
                n_gaps, n = kinds.get(GAP, 0), kinds.get(LEFT, 0)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def numbered(found: DataFrame) -> DataFrame:
    """``found``, written, with a number ``_row`` that tells its rows apart."""
    return materialize(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs ``docs``; one row per piece.

    Null and empty texts are one piece that holds only the closing id. Rows
    with equal or null ids are packed as rows of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    return pack(numbered(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
