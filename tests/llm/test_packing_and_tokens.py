import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tracewise.llm import packing as P
from tracewise.llm import token_counts as T
from tracewise.llm.common import BoundedCache

from .helpers import ODD, SF, documents, sample

TEXTS = ["it's don't, \"we're!! <|endoftext|> x<|STARTOFTEXT|>", "ÀÉ«a»,b. ΑΣ ΣΑΣ. áb é, 'S 12.5%,3|4 漢字、かな。", "a.'s b,'t c!'re ..,, x!!, <s> <0x41>", "\x1cx\x1dy tab\tnew\x0bz", "".join(map(chr, range(256))), "".join(chr(i) + "a" for i in range(256)), "É\xa0È\x85µªº²³¹¼×÷ß'S it'LL ÿ"]


def odd_texts(n=400):
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("aZé'.,%|<>0 9\ń«漢s t") for _ in range(40)) for _ in range(n)]


def test_ids_equal_the_tokenizers():
    path = P.default_tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = odd_texts() + [t for _, t in sample("documents", "doc_id, text")]
    got = P.packed_ids([t.encode() for t in texts], path)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


def test_counts_equal_the_unigram_tokenizer():
    path = T.default_model_path()
    model = Tokenizer(models.Unigram(list(T.vocabulary(path)), unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.SPACE, prepend_scheme="always", split=True)
    texts = odd_texts() + [t[:3000] for _, t in sample("documents", "doc_id, text")]
    for t, (words, tokens) in zip(texts, T.count_tokens([t.encode() for t in texts], path)):
        split = t.encode().split()
        assert (words, tokens) == (len(split), sum(len(model.encode(w.decode(), add_special_tokens=False).ids) for w in split)), t[:60]


def test_token_count_ties_and_unknowns(tmp_path, monkeypatch):
    """Equal scores: the longest last piece is kept; unknown runs are one piece without byte pieces."""
    pieces = (("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0))
    model = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=False))
    monkeypatch.setattr(T, "vocabulary", lambda path: pieces)
    T.automaton.cache_clear()
    for w in ("ab", "aab", "abab", "éa", "aéèb", "漢漢", "ba", "", "é"):
        assert T.count_pieces("▁" + w, "tiny") == len(model.encode("▁" + w).ids), w
    T.automaton.cache_clear()


def test_token_count_rows(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in T.token_counts(documents(spark)).collect()}
    assert got[-1] == got[-2] == got[-3] == (0, 0) and got[-4][0] == 1 and got[-8][0] == 32_000
    assert T.op7_token_counts(spark, SF).count() == len(sample("documents", "doc_id"))
    assert T.token_counts(documents(spark, [])).count() == 0


def test_cache_keeps_what_is_in_use():
    calls = []
    cache = BoundedCache(lambda ws: calls.extend(ws) or [len(w) for w in ws], limit=3)
    for words in ([b"a", b"b"], [b"a", b"cc"], [b"a", b"dd"], [b"a", b"b"], [b"e", b"f", b"g", b"hhh"]):
        known = cache.prepare(set(words))
        assert [known[w] for w in words] == [len(w) for w in words]
    assert calls.count(b"a") == 1


def check_packing(rows, capacity):
    """Gapless sequences within the capacity."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in room if g >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


def drawn_lengths(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 30, 500]))] + [capacity // 3] * (200 if seed % 2 else 0)
    return capacity, lengths + [1] * (seed % 3) * 40


@pytest.mark.parametrize("seed", range(8))
def test_a_sweep_is_best_fit(seed):
    """Against a plain search for the tightest gap, with gaps given, with and without opening."""
    rng = random.Random(seed)
    capacity, lengths = drawn_lengths(seed)
    given = [rng.randint(1, capacity) for _ in range(rng.choice([0, 5, 60]))]
    for opening in (False, True):
        rooms, missed = list(given), 0
        for n in sorted(lengths, reverse=True):
            fits = [k for k, g in enumerate(rooms) if g >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            elif opening:
                rooms.append(capacity - n)
            else:
                missed += 1
        at, offsets, left = P.successors(sorted(lengths, reverse=True), given, capacity, opening)
        assert sorted(left) == sorted(rooms) and at.count(-1) == missed
        used = {k: capacity - g for k, g in enumerate(given)}
        for n, k, o in zip(sorted(lengths, reverse=True), at, offsets):
            if k >= 0:
                assert o == used.get(k, 0)
                used[k] = o + n
        assert all(capacity - left[k] == u for k, u in used.items())


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_as_good_as_best_fit_decreasing(spark, seed):
    """As many sequences as one plain best fit in one part, hardly more in many, whatever the bands."""
    capacity, lengths = drawn_lengths(seed)
    rows = spark.createDataFrame([(i % 7, 0, 0, n, 5) for i, n in enumerate(lengths)], P.PIECES)
    want = best_fit(lengths, capacity)
    for part_rows, bands, more in ((10**6, (1 / 2,), 0), (10**6, P.BANDS, 1 + want // 100), (60, P.BANDS, 2 + want // 20)):
        got = P.pack(P.numbered(rows), capacity, part_rows, bands).collect()
        assert sorted(r["length"] for r in got) == sorted(lengths)
        assert check_packing(got, capacity) <= want + more


def test_pieces_and_sequences(spark):
    rows = sample("documents", "doc_id, text") + ODD
    got = P.pack_documents(documents(spark, rows), capacity=512).collect()
    used = check_packing(got, 512)
    total = sum(r["length"] for r in got)
    assert used <= math.ceil(total / 512) * 1.02 + 1
    path, pieces = P.default_tokenizer_path(), []
    for (i, _), ids in zip(rows, P.packed_ids([(t or "").encode() for _, t in rows], path)):
        ids += b"\0\0\0\0"
        pieces += [(i, k, a // 4, len(ids[a : a + 2048]) // 4, zlib.crc32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(pieces, key=repr)


def test_many_equal_lengths(spark):
    got = P.pack_documents(documents(spark, [(i, "one two three") for i in range(500)]), capacity=10).collect()
    assert check_packing(got, 10) == 250 and len({(r["sequence_id"], r["offset"]) for r in got}) == 500
    assert P.pack_documents(documents(spark, [])).count() == 0
