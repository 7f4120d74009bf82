"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits share a variant that differs
from each in at most h bits, and any two that share one differ in at most 2h.
So every fingerprint emits all variants within h bits and those that collide
are linked. A fingerprint goes to a bucket (variant prefix) once, for every
prefix that its variants have, and its variants within the bucket are made
after the shuffle: the shuffle carries some tens of rows for a fingerprint
instead of two thousand. Only distinct fingerprints take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, hinted, map_rows, materialize, scratch, spaced_words, table, tidy
from .components import components

_CHUNK = 1 << 16


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """``k``-word shingles, repeats included; of fewer words, but not none, the whole sequence."""
    words = spaced_words(text)
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [line[s : e - 1] for s, e in zip([0, *ends], ends[k - 1 :])]


def fingerprint(parts: list[bytes], seeds: tuple[int, ...]) -> list[bytes]:
    """One 64-bit fingerprint (8 bytes, highest first) for each seed; zero if there are no parts."""
    out = []
    for seed in seeds:
        digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
        for i in range(0, len(parts), _CHUNK):
            data = b"".join([digest(x, seed) for x in parts[i : i + _CHUNK]])
            ones += np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(parts)).tobytes())
    return out


def fingerprints(docs: DataFrame, k: int, seeds: tuple[int, ...] = (42,), distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): one signed long for each seed; with ``distinct``, repeated shingles count once."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = (shingles(t.as_py(), k) for t in batch.column(1))
        found = [fingerprint(list(set(x)) if distinct else x, seeds) for x in each]
        cols = [np.frombuffer(b"".join(f[i] for f in found), dtype=">i8").astype(np.int64) for i in range(len(seeds))]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=["doc_id", *(f"f{i}" for i in range(len(seeds)))])

    return map_rows(as_bytes(docs, id_col, text_col), lambda: step, ", ".join(["doc_id long", *(f"f{i} long" for i in range(len(seeds)))]))


@dataclass(frozen=True)
class Block:
    """Bits of word ``word``, ``width`` of them above the lowest ``low``."""

    word: int
    low: int
    width: int

    def column(self, prefix_bits: int):
        """The block's first bits, as a column."""
        shift = self.low + self.width - prefix_bits
        return F.shiftrightunsigned(F.col(f"f{self.word}"), shift).bitwiseAND(F.lit((1 << prefix_bits) - 1))

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        value = words[self.word].view(np.uint64) >> np.uint64(self.low)
        return value & np.uint64((1 << self.width) - 1) if self.width < 64 else value


def masks(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def stars(values: np.ndarray, left: np.ndarray, width: int, radius: int, limit: int) -> np.ndarray:
    """Links (centre, member) among rows that share a variant.

    ``values`` are the ``width`` bits still to be varied and ``left`` how many
    of them may change. The members of one variant are linked to the first of
    them, so links stay linear in the variants. If there would be more than
    ``limit`` variants, they are made by parts with a common further prefix.
    """
    sizes = {r: len(masks(width, r)) for r in range(radius + 1)}
    total = sum(sizes[r] * int((left == r).sum()) for r in sizes)
    if total > limit and width > 8:
        rest, out = width - 6, []
        head, ball = values >> np.uint64(rest), np.array(masks(6, radius), dtype=np.uint64)
        for target in np.unique(head[:, None] ^ ball).tolist():
            far = ones(head ^ np.uint64(target)).astype(np.int64)
            mine = np.flatnonzero(far <= left)
            if len(mine) > 1:
                out.append(mine[stars(values[mine] & np.uint64((1 << rest) - 1), left[mine] - far[mine], rest, radius, limit)])
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), dtype=np.int64)
    variants, rows = [], []
    for r in sizes:
        mine = np.flatnonzero(left == r)
        ball = np.array(masks(width, r), dtype=np.uint64)
        variants.append((values[mine][:, None] ^ ball).ravel())
        rows.append(np.repeat(mine, len(ball)))
    variant, row = np.concatenate(variants), np.concatenate(rows)
    order = np.argsort(variant, kind="quicksort")
    variant, row = variant[order], row[order]
    if len(variant) < 2:
        return np.empty((0, 2), dtype=np.int64)
    new = np.r_[True, variant[1:] != variant[:-1]]
    starts = np.flatnonzero(new)
    if len(starts) == len(variant):
        return np.empty((0, 2), dtype=np.int64)
    centre = np.minimum.reduceat(row, starts)[np.cumsum(new) - 1]
    pairs = np.unique((centre * len(values) + row)[centre != row])
    return np.stack([pairs // len(values), pairs % len(values)], axis=1)


def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the links that a minimum spanning forest by distance keeps, ties by the nodes.

    What the links connect stays connected, so a bucket of near copies gives a
    link less than it has members.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), apart))
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def ball_links(nodes: DataFrame, blocks: list[Block], radius: int, n_words: int, within: int, prefix_bits: int, limit: int = 1_000_000) -> DataFrame:
    """Links (a, b) between nodes that collide in a block and differ in ``within`` bits at most overall.

    ``nodes`` has columns node and f0, f1, ...; all rows of a bucket are held
    by one task, their variants by parts of ``limit``. Of the links in a
    bucket, those of a minimum spanning forest are returned.
    """
    half, names = radius // 2, [f"f{i}" for i in range(n_words)]
    keys = ",".join(f"{m}L" for m in masks(prefix_bits, half))
    parts = [
        nodes.select(F.explode(F.expr(f"array({keys})")).alias("_mask"), "node", *names).select(
            (F.col("_mask").bitwiseXOR(blocks[i].column(prefix_bits)) + F.lit(i << prefix_bits)).alias("bucket"), "node", *names
        )
        for i in range(len(blocks))
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)

    def collide(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node = group.column("node").to_numpy()
        words = [np.ascontiguousarray(group.column(n).to_numpy()) for n in names]
        bucket = int(group.column("bucket")[0].as_py())
        block = blocks[bucket >> prefix_bits]
        value, rest = block.of(words), block.width - prefix_bits
        far = ones((value >> np.uint64(rest)) ^ np.uint64(bucket & ((1 << prefix_bits) - 1))).astype(np.int64)
        found = stars(value & np.uint64((1 << rest) - 1), half - far, rest, half, limit)
        a, b = found[:, 0], found[:, 1]
        apart = sum(ones((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in words)
        ok = apart <= within
        a, b = node[a[ok]], node[b[ok]]
        kept = forest(a, b, apart[ok])
        tidy()
        return pa.table({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(collide, "a long, b long")


def prefix_for(count: int, half: int = 2, load: int = 20_000) -> int:
    """Prefix bits, 8 to 32, with which an average bucket holds ``load`` of ``count`` fingerprints' rows or fewer.

    Only the size of buckets depends on it, not what is linked.
    """
    return next((b for b in range(8, 32) if count * sum(math.comb(b, r) for r in range(half + 1)) <= load << b), 32)


def near_classes(found: DataFrame, prefix_bits: int | None = None) -> DataFrame:
    """(f0, component_id) for every distinct fingerprint of ``found`` (doc_id, f0), linked at 4 bits or fewer."""
    nodes = found.groupBy("f0").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("f0"))
    nodes = materialize(nodes, "fingerprints")
    links = materialize(ball_links(nodes, [Block(0, 0, 64)], 4, 1, 4, prefix_bits or prefix_for(nodes.count())).distinct(), "links")
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("f0", "first", F.coalesce("root", "f0").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("f0", "component_id")


def near_duplicates(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of ``k``-word shingles link at 4 or fewer differing bits;
    component_id is the smallest id reachable. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Repeated rows are all
    returned; a null id is never the smallest (a class of null ids only has a
    null component_id). Other columns are ignored.
    """
    found = materialize(fingerprints(docs, k, (42,), id_col=id_col, text_col=text_col), "simhash")
    with scratch(docs.sparkSession) as keep:
        labels = keep(materialize(near_classes(found), "classes"))
    return found.join(labels, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: Prefix rows of an average bucket, links verified at a time, documents sampled for common shingles, most of these, and pairs looked at at once.
LOAD, PART, SAMPLE, COMMON, PAIRS = 100_000, 200_000, 10_000, 200_000, 1 << 18
#: Bits of the map that bounds how far two sets differ, and sets with one key that a task compares with each other or with as many more.
MAP_BITS, SIDE = 2_048, 5_000
#: Keys of eight bytes that a broadcast may send.
BROADCAST_KEYS = 2_000_000


def hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x) for x in set(shingles(text, k))]), dtype=">i8").astype(np.int64))


def common_shingles(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that recur in a sample of documents, and how often.

    They only order shingles, so whatever the sample holds, no pair is lost.
    """
    rows = as_bytes(docs, id_col, text_col)
    rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, rows.count() // SAMPLE))) == 0)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashes(t.as_py(), k) for t in batch.column(1)]))], names=["key"])

    often = map_rows(rows, lambda: step, "key long").groupBy("key").count().where("count > 3").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    key, count = often.column("key").to_numpy(), often.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set's hashes, rare ones before common ones: sets of at least ``similarity`` have one of them in common."""
    take = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if not len(common):
        return found[:take]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))[:take]]


def parity_map(found: np.ndarray) -> bytes:
    """For each of :data:`MAP_BITS` residues, whether the set has an odd number of hashes with it.

    Maps of two sets differ in no more bits than the sets in hashes.
    """
    return np.packbits(np.bincount(found & (MAP_BITS - 1), minlength=MAP_BITS).astype(np.uint8) & 1).tobytes()


def of_hashes(found: np.ndarray) -> int:
    """The fingerprint of a set of shingles from its hashes, as a signed long; zero if there are none."""
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), _CHUNK):
        bits += np.unpackbits(found[i : i + _CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(found)).tobytes(), "big", signed=True)


def shingle_prefixes(docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, f0, f1, size, keys, map, simhash): digest and size of the shingle set, its prefix, its parity map, its fingerprint."""
    common, counts = common_shingles(docs, k, id_col, text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [hashes(t.as_py(), k) for t in batch.column(1)]
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.tobytes()) for x in sets]), dtype=">i8").astype(np.int64).reshape(-1, 2)
        keys = pa.array([prefix(x, similarity, common, counts) for x in sets], pa.list_(pa.int64()))
        columns = [batch.column(0), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([len(x) for x in sets], pa.int32()), keys, pa.array([parity_map(x) for x in sets], pa.binary()), pa.array([of_hashes(x) for x in sets], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "f0", "f1", "size", "keys", "map", "simhash"])

    return map_rows(as_bytes(docs, id_col, text_col), lambda: step, "doc_id long, f0 long, f1 long, size int, keys array<long>, map binary, simhash long")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes), written: shingle sets of the documents in ``ids`` (column node)."""
    rows = as_bytes(docs, id_col, text_col).join(hinted(ids), F.col("_id") == F.col("node"), "left_semi")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(t.as_py(), k) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "hashes"])

    sets = materialize(map_rows(rows, lambda: step, "node long, hashes array<long>"), "shingles")
    return sets if sets.count() <= ids.count() else sets.dropDuplicates(["node"])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, size, n) of prefix keys that several nodes have; n is how many these are."""
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    repeated = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    few = repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(repeated) if few else repeated, "key")


def able(counted: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) of ``counted`` (a, b, sa, sb, n: sizes and prefix keys in common) that can be similar.

    What sets have in common beside the keys of both prefixes comes after one
    of the prefixes, so it's no more than the longer of the two rests.
    """
    rest = f"ceil({similarity!r} * greatest(sa, sb) - 1e-9) - 1"
    links = counted.groupBy("a", "b").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.sum("n").alias("n"))
    return links.where(f"n + {rest} >= {similarity / (1 + similarity)!r} * (sa + sb) - 1e-9").select("a", "b")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that ball hashing finds: within 4 bits, of distinct fingerprints by the smallest node of each.

    Nodes with one fingerprint are linked to that node.
    """
    first = materialize(nodes.groupBy(F.col("simhash").alias("f0")).agg(F.min("node").alias("node")), "fingerprints")
    near = ball_links(first, [Block(0, 0, 64)], 4, 1, 4, prefix_for(first.count(), load=LOAD)).distinct()
    same = nodes.join(first.select(F.col("f0").alias("simhash"), F.col("node").alias("a")), "simhash").where("a < node").select("a", F.col("node").alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same)


def first_links(shared: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) from the smallest node of each key to others that are likely to be similar to it."""
    centre = materialize(shared.groupBy("key").agg(F.min(F.struct("node", "size")).alias("c")), "centres")
    pairs = shared.join(hinted(centre), "key").where(f"c.node < node AND least(c.size, size) >= {similarity!r} * greatest(c.size, size) - 1e-9")
    return able(pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.size").alias("sa"), F.col("size").alias("sb"), F.lit(1).alias("n")), similarity)


def open_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, maps: np.ndarray, side: np.ndarray, similarity: float, step: int = PAIRS) -> tuple[np.ndarray, ...]:
    """a, b, their sizes and how many keys they have in common, for all pairs of different roots with a key in common that can be similar.

    Sizes and parity ``maps`` (a row of 64-bit words for each place) rule pairs
    out. Of a key whose ``side`` isn't negative, only pairs of different sides
    count. ``step`` pairs are looked at at a time.
    """
    order = np.lexsort((root, key))
    key, node, size, root, maps, side = (x[order] for x in (key, node, size, root, maps, side))
    names, at_first, number = np.unique(node, return_index=True, return_inverse=True)
    of_key = np.r_[True, key[1:] != key[:-1]]
    of_root = of_key | np.r_[True, root[1:] != root[:-1]]
    after, last = (np.r_[np.flatnonzero(new)[1:], len(key)][np.cumsum(new) - 1] for new in (of_root, of_key))
    ends = np.cumsum(last - after)
    pairs, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for at in range(0, int(ends[-1]), step):
        flat = np.arange(at, min(at + step, int(ends[-1])))
        i = np.searchsorted(ends, flat, side="right")
        j = last[i] - (ends[i] - flat)
        ok = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        both = size[i].astype(np.int64) + size[j]
        apart = np.zeros(len(i), dtype=np.int64)
        for w in range(maps.shape[1]):
            apart += np.bitwise_count(maps[i, w] ^ maps[j, w])
        ok = apart <= both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9)
        i, j = number[i[ok]], number[j[ok]]
        new, n = np.unique(np.minimum(i, j) * len(names) + np.maximum(i, j), return_counts=True)
        pairs, where = np.unique(np.r_[pairs, new], return_inverse=True)
        counts = np.bincount(where, np.r_[counts, n], len(pairs)).astype(np.int64)
    a, b = pairs // len(names), pairs % len(names)
    return names[a], names[b], size[at_first[a]], size[at_first[b]], counts


def other_links(shared: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float, side: int = SIDE) -> DataFrame:
    """Links (a, b), a < b, of nodes that can be similar and that ``roots`` (node, root) doesn't connect.

    Keys whose nodes are all connected go first. Of a key with more than
    ``side`` nodes, parts of about ``side`` meet two at a time, each two in a
    group of their own, so no task holds more than two parts of one key.
    """
    rooted = shared.join(hinted(roots), "node", "left").select("key", "node", "size", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = materialize(rooted.join(hinted(materialize(apart, "apart")), "key", "left_semi"), "open")
    buckets = max(8, rows.count() // LOAD)
    rows = rows.join(nodes.select("node", "map"), "node")
    parts = F.ceil(F.col("n") / F.lit(side)).cast("long")
    own = F.when(parts > 1, F.pmod(F.xxhash64("node"), parts))
    rows = rows.withColumns({"_own": own, "_other": F.explode(F.when(parts > 1, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.lit(None).cast("long"))))})
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    rows = rows.select(
        "key", "node", "size", "root", "map",
        F.coalesce(F.when(F.col("_own") != F.col("_other"), F.col("_own")), F.lit(-1).cast("long")).alias("side"),  # within a part, all pairs count
        F.when(parts > 1, pair).otherwise(F.pmod("key", F.lit(buckets))).alias("bucket"),
    )

    def pairs(group: pa.Table) -> pa.Table:
        maps = np.frombuffer(b"".join(group.column("map").to_pylist()), dtype=np.uint64).reshape(-1, MAP_BITS // 64)
        found = open_pairs(*(group.column(c).to_numpy() for c in ("key", "node", "size", "root")), maps, group.column("side").to_numpy(), similarity)
        tidy()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("a", "b", "sa", "sb", "n"), found)})

    return able(rows.groupBy("bucket").applyInArrow(pairs, "a long, b long, sa long, sb long, n long"), similarity)


def verified(links: DataFrame, docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The links of at least ``similarity``; ``PART`` or so are compared at a time, so that memory doesn't grow with them."""
    sets = shingle_sets(docs, links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k, id_col, text_col)
    parts, out = links.count() // PART + 1, None
    common = F.size(F.array_intersect("x", "y"))
    for i in range(parts):
        some = links.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
        first = some.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
        both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        close = materialize(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "similar")
        out = close if out is None else out.union(close)
    return out


def similar_links(docs: DataFrame, found: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct shingle sets (f0, f1, node; node the smallest id) and links of at least ``similarity`` that connect all that are similar.

    Ball hashing of fingerprints gives the first candidates; each is compared
    exactly. Fingerprints tell by chance only how similar sets are, so for the
    rest, similar sets have a key of their prefixes in common: the smallest node
    of each key is compared with the others, and then all pairs with a key in
    common that the similar ones among those links leave apart and that sizes,
    parity maps and counts of common keys allow.
    """
    first = (F.first(c).alias(c) for c in ("size", "keys", "map", "simhash"))  # of equal sets these are equal
    nodes = materialize(found.where("doc_id is not null").groupBy("f0", "f1").agg(F.min("doc_id").alias("node"), *first), "sets")
    shared = materialize(shared_keys(nodes), "shared")
    tried = materialize(simhash_links(nodes).union(first_links(shared, similarity)).distinct(), "candidates")
    links = verified(tried, docs, k, similarity, id_col, text_col)
    others = materialize(other_links(shared, components(links), nodes, similarity).join(tried, ["a", "b"], "left_anti"), "candidates")
    return nodes.select("f0", "f1", "node"), links.union(verified(others, docs, k, similarity, id_col, text_col))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each class of near duplicates; all columns stay.

    Similarity is that of shingle sets, and every similar pair counts. Null,
    empty and blank texts have the same empty set, so one of them stays. Rows
    without an id are kept and not compared; of rows that repeat an id and its
    text, one stays. Columns may have any names; an empty table stays empty.
    """
    name = fresh("_node", docs.columns)
    with scratch(docs.sparkSession) as keep:
        found = materialize(shingle_prefixes(docs, k, similarity, id_col, text_col), "prefixes")
        nodes, links = similar_links(docs, found, k, similarity, id_col, text_col)
        rooted = nodes.join(components(materialize(links, "links")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        labelled = found.select("doc_id", "f0", "f1").join(rooted.select("f0", "f1", "root"), ["f0", "f1"])
        dropped = keep(materialize(labelled.where("doc_id <> root").select(F.col("doc_id").alias(name)).distinct(), "dropped"))
        repeated = keep(materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), "repeated"))
    here = F.col(id_col).cast("long")
    kept = docs.join(hinted(dropped), here == F.col(name), "left_anti")
    if repeated.isEmpty():
        return kept
    again = hinted(repeated)
    return kept.join(again, here == F.col(name), "left_anti").unionByName(kept.join(again, here == F.col(name), "left_semi").dropDuplicates([id_col, text_col]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
