"""Token counts under a unigram vocabulary, without making the tokens.

For each word an Aho-Corasick automaton of the vocabulary enumerates all
pieces that occur in it; dynamic programming carries, for each position, the
best score of a segmentation that ends there and its number of pieces. Only
the count leaves the search: no back pointers are kept.

Tie and fallback rules are those of the unigram tokenizer: a segmentation
replaces another only with a strictly higher score, candidates come in order
of their start (the longest piece first), a character that starts no
one-character piece may be unknown at the lowest score less 10, runs of
unknown characters fuse into one, and an unknown run is spelt as byte pieces
when the vocabulary has all of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, as_bytes, grouped, map_rows, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


@lru_cache(maxsize=2)
def automaton(path: str):
    import ahocorasick

    pieces = vocabulary(path)
    found = ahocorasick.Automaton()
    for piece, score in pieces:
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found, min(score for _, score in pieces) - UNKNOWN_PENALTY, frozenset(piece for piece, _ in pieces)


def count_pieces(word: str, path: str) -> int:
    """Pieces of the best segmentation of one word (its leading space mark included)."""
    auto, unknown, known = automaton(path)
    n = len(word)
    # for each position: score, pieces so far without those of the open unknown run, start of that run or -1
    score, count, run = [0.0] + [-inf] * n, [0] * (n + 1), [-1] * (n + 1)

    def close(end: int, at: int, single: bool) -> None:
        """Settles position ``end``, whose best last piece starts at ``at`` (-1: none)."""
        if not single and (at < 0 or score[end - 1] + unknown > score[end]):
            score[end], count[end] = score[end - 1] + unknown, count[end - 1]
            run[end] = run[end - 1] if run[end - 1] >= 0 else end - 1
        else:
            count[end] = count[at] + 1 + (spelt(word[run[at] : at], known) if run[at] >= 0 else 0)

    now, best, at, single = 1, -inf, -1, False
    for last, (length, s) in auto.iter(word):  # by end, longest first
        while now <= last:
            close(now, at, single)
            now, best, at, single = now + 1, -inf, -1, False
        total = score[last + 1 - length] + s
        if total > best:
            score[last + 1] = best = total
            at = last + 1 - length
        single |= length == 1
    while now <= n:
        close(now, at, single)
        now, at, single = now + 1, -1, False
    return count[n] + (spelt(word[run[n] :], known) if run[n] >= 0 else 0)


def spelt(chars: str, known: frozenset[str]) -> int:
    """Pieces of an unknown run: its bytes if the vocabulary has them all, else one."""
    data = chars.encode("utf-8", "surrogatepass")
    return len(data) if all(f"<0x{b:02X}>" in known for b in data) else 1


@lru_cache(maxsize=2)
def count_cache(path: str) -> BoundedCache:
    return BoundedCache(lambda words: [count_pieces(SPACE + w.decode("utf-8", "replace"), path) for w in words], limit=300_000)


def count_tokens(texts: list[bytes], path: str) -> list[tuple[int, int]]:
    """Words and tokens of each text: white space separates words and each word starts with the space mark."""
    split = [t.split() for t in texts]
    known = count_cache(path).prepare(set().union(*split)).__getitem__
    return [(len(words), sum(map(known, words))) for words in split]


def counter(path: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for texts in grouped(batch.column(1)) for x in count_tokens(texts, path)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["doc_id", "n_words", "n_tokens"]
        )

    step.close = lambda: count_cache(path).clear()
    return step


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    Null and empty texts count zero; repeated rows count each; other columns
    are ignored. Any scored piece list works as the unigram vocabulary; the
    file is a parameter and is never changed.
    """
    path = model or default_model_path()
    return map_rows(as_bytes(docs, id_col, text_col), lambda: counter(path), "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
