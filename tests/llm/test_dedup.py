import random

import numpy as np
import pytest
import xxhash

from tracewise.llm import simhash as H
from tracewise.llm.components import components

from .helpers import ODD, SF, documents, sample


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def brute_components(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fingerprint(t), []).append(i)
    keys = list(fps)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in fps.items()}
    found = classes(range(len(keys)), [(a, b) for a in range(len(keys)) for b in range(a) if (keys[a] ^ keys[b]).bit_count() <= 4])
    least = {}
    for i, r in found.items():
        if low[keys[i]] is not None:
            least[r] = min(least.get(r, low[keys[i]]), low[keys[i]])
    return sorted(((i, f"{k:016x}", least.get(found[n])) for n, k in enumerate(keys) for i in fps[k]), key=repr)


def test_matches_all_pairs_on_sample_and_odd_rows(spark):
    rows = sample("documents", "doc_id, text") + [r for r in ODD if not r[1] or len(r[1]) < 20_000]
    got = H.near_duplicates(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_query_columns(spark):
    assert H.op1_simhash(spark, SF).columns[:3] == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(spark):
    assert H.near_duplicates(documents(spark, [])).count() == 0
    assert H.drop_near_duplicates(documents(spark, [], extra=False)).count() == 0


def links(values, prefix, limit=4_000_000):
    """Links of a block of 64-bit values, bucket by bucket as the operator makes them."""
    out = set()
    v = np.array(values, dtype=np.uint64)
    rest = 64 - prefix
    head = v >> np.uint64(rest)
    for bucket in {int(h) ^ m for h in head for m in H.masks(prefix, 2)}:
        far = H.ones(head ^ np.uint64(bucket)).astype(int)
        mine = np.flatnonzero(far <= 2)
        for a, b in H.stars(v[mine] & np.uint64((1 << rest) - 1), 2 - far[mine], rest, 2, limit):
            out.add((int(mine[a]), int(mine[b])))
    return out


@pytest.mark.parametrize("limit", [4_000_000, 3_000])
def test_ball_hashing_finds_exactly_the_pairs_within_four_bits(limit):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(12)}
    for v in list(values):
        for flips in (1, 2, 3, 4, 5, 6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    values = sorted(values)
    want = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
    found = links(values, 6, limit)
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in found)
    assert classes(range(len(values)), found) == classes(range(len(values)), want)


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(7, 100)] + [(500, 501)] * 3 + [(9, 9)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = classes({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    a, b = set(H.shingles(a.encode(), 5)), set(H.shingles(b.encode(), 5))
    return len(a & b) / len(a | b)


def test_one_of_each_similar_class_stays_and_others_are_kept(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, group = [], 0
    for group in range(30):
        words = rng.choices(vocabulary, k=rng.randrange(80, 400))
        rows.append((group * 10, " ".join(words)))
        for copy in range(1, 4):
            other = list(words)
            for _ in range(copy - 1):  # the first copy is exact
                other[rng.randrange(len(other))] = "changed"
            rows.append((group * 10 + copy, " ".join(other)))
        half = words[: len(words) // 2] + rng.choices(vocabulary, k=len(words) // 2)
        rows.append((group * 10 + 9, " ".join(half)))  # half in common only
    kept = {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()}
    text = dict(rows)
    for g in range(30):
        ids = [g * 10 + c for c in range(4)]
        assert g * 10 in kept and g * 10 + 9 in kept
        for i in ids[1:]:
            similar = any(jaccard(text[i], text[j]) >= 0.8 for j in ids if j != i)
            assert (i not in kept) or not similar


def test_filter_keeps_rows_without_id_and_one_of_repeated_rows(spark):
    rows = [(5, "one two three four five six seven"), (5, "one two three four five six seven"), (None, "one two three four five six seven"), (6, "other words " * 9)]
    out = H.drop_near_duplicates(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [5, 6, None]


def kept_by_brute_force(rows):
    """Ids of the rows that stay if all pairs are compared; texts differ."""
    sets = {i: set(H.shingles(t.encode(), 5)) for i, t in rows}
    ids = sorted(sets)
    similar = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (c := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    return {i for i, r in classes(ids, similar).items() if i == r}, similar


def test_similar_documents_among_many_that_share_half_their_text(spark):
    rng = random.Random(21)
    template, rows = [f"t{i}" for i in range(210)], []
    for i in range(500):
        own = [f"d{i}x{n}" for n in range(90)]
        rows.append((i, " ".join(template + own)))
        if i % 5 == 0:
            for n in rng.sample(range(0, 90, 6), 6):
                own[n] = f"e{i}x{n}"
            rows.append((1000 + i, " ".join(template + own)))
    rng.shuffle(rows)
    want, similar = kept_by_brute_force(rows)
    assert len(similar) >= 100 and len(want) == 500
    assert {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()} == want


def test_a_similar_pair_with_a_third_between_that_is_similar_to_neither(spark):
    rng, rows = random.Random(22), []
    for g in range(200):
        a = [f"g{g}w{n}" for n in range(204)]
        spots = rng.sample(range(4, 200, 5), 7)
        b, c = list(a), list(a)
        for n in spots[:4]:
            c[n] = f"g{g}c{n}"
        for n in spots[:2]:
            b[n] = c[n]
        for n in spots[4:]:
            b[n] = f"g{g}b{n}"
        rows += [(g * 10, " ".join(a)), (g * 10 + 1, " ".join(b)), (g * 10 + 2, " ".join(c))]
    want, similar = kept_by_brute_force(rows)
    assert sorted(similar) == [(g * 10 + 2, g * 10) for g in range(200)]
    assert {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()} == want


def test_links_are_verified_in_parts_and_pairs_apart_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 7)
    rng = random.Random(24)
    key, node, root = np.array([rng.randrange(9) for _ in range(200)]), np.arange(200), np.array([rng.randrange(6) for _ in range(200)])
    blank, everywhere = np.zeros((200, 8), dtype=np.uint64), np.full(200, -1)
    a, b, *_, n = H.open_pairs(key, node, np.full(200, 10), root, blank, everywhere, 0.8, step=50)
    assert set(n.tolist()) == {1}
    side = node % 2
    c, d, *_ = H.open_pairs(key, node, np.full(200, 10), root, blank, side, 0.8, step=50)
    assert set(zip(c.tolist(), d.tolist())) == {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x % 2 != y % 2}
    assert set(zip(a.tolist(), b.tolist())) == {(a, b) for b in range(200) for a in range(b) if key[a] == key[b] and root[a] != root[b]}
    text = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(text[:i] + ["new"] + text[i + 1 :])) for i in range(0, 200, 5)]
    assert [r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()] == [0]


def test_every_pair_at_just_the_similarity_is_found(spark):
    rng, rows = random.Random(23), []
    for g in range(400):
        a = [f"g{g}w{n}" for n in range(184)]
        b = list(a)
        for n in rng.sample(range(4, 180, 5), 4):
            b[n] = f"g{g}b{n}"
        rows += [(g * 10, " ".join(a)), (g * 10 + 1, " ".join(b))]
    assert all(jaccard(rows[n][1], rows[n + 1][1]) == 0.8 for n in range(0, 800, 2))
    assert {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()} == {g * 10 for g in range(400)}


def test_parity_maps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900, 5000):
        a = rng.integers(-(2**62), 2**62, n)
        b = np.unique(np.r_[a[n // 9 :], rng.integers(-(2**62), 2**62, n // 9)])
        x, y = (np.frombuffer(H.parity_map(v), dtype=np.uint8) for v in (np.unique(a), b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_near_copies_that_are_apart_from_one_another(spark, monkeypatch):
    """A large group of copies of one text, each changed much, in parts of a few: as brute force finds, however keys are split."""
    rng, base = random.Random(31), [f"w{i}" for i in range(160)]
    rows = []
    for i in range(160):
        own = list(base)
        for n in rng.sample(range(0, 160, 5), rng.choice([1, 2, 3, 4, 5])):
            own[n] = f"x{i}n{n}"
        rows.append((i, " ".join(own)))
    want, similar = kept_by_brute_force(rows)
    assert 5 < len(want) < 150 and similar
    for side in (5_000, 20):
        monkeypatch.setattr(H.other_links, "__defaults__", (side,))
        assert {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()} == want


def test_near_duplicates_of_real_texts_equal_brute_force(spark):
    """All pairs of the sample table with a shingle in common, compared in full; columns have the operator's own names."""
    from collections import defaultdict

    rows = sample("documents", "doc_id, text")
    rows += [(10_000 + i, " ".join([*t.split()[:-6], "and", "so", "it", "ends", "here", str(i)])) for i, t in rows[:60]]
    sets, at = {i: set(H.shingles(t.encode(), 5)) for i, t in rows}, defaultdict(list)
    for i, x in sets.items():
        for h in x or {b""}:
            at[h].append(i)
    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    similar = [(a, b) for a, b in pairs if (c := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    want = {i for i, r in classes(sets, similar).items() if i == r}
    docs = documents(spark, rows).withColumnsRenamed({"score": "node", "_id": "_node", "lang": "root", "source": "_row"})
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_prefixes_grow_with_the_fingerprints():
    assert [H.prefix_for(n) for n in (0, 1000, 10**6, 10**9)] == sorted(H.prefix_for(n) for n in (0, 1000, 10**6, 10**9))
    assert H.prefix_for(10**9) >= 20


def test_the_near_duplicate_stage_goes_through_ball_hashing(spark, monkeypatch):
    """Copies with one changed word among 4,000: without the join on prefixes, ball hashing alone links them, and keeps others apart."""
    rng, rows = random.Random(41), []
    for g in range(40):
        a = [f"g{g}w{n}" for n in range(4000)]
        b = list(a)
        b[rng.randrange(4000)] = "new"
        rows += [(g * 10, " ".join(a)), (g * 10 + 1, " ".join(b))]
    none = lambda *_: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(H, "first_links", none)
    monkeypatch.setattr(H, "other_links", none)
    want, _ = kept_by_brute_force(rows)
    assert {r["doc_id"] for r in H.drop_near_duplicates(documents(spark, rows)).collect()} == want == {g * 10 for g in range(40)}


def test_fingerprint_of_hashes_is_that_of_the_shingles():
    for text in (b"", b"one", b"a b c d e f g", b" ".join(b"w%d" % (i % 700) for i in range(2000))):
        parts = sorted(set(H.shingles(text, 5)))
        assert H.of_hashes(H.hashes(text, 5)) == int.from_bytes(H.fingerprint(parts, (0,))[0], "big", signed=True)
