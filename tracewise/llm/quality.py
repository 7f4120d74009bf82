"""Quality filtering by weak supervision, in DataFrame operations only.

Each rule votes on a document (good, bad) or abstains. The votes of all
documents are counted by pattern (there are at most 3 to the number of rules),
expectation-maximisation over the counts estimates how often each rule says
bad of good and of bad documents, and a document is kept if the posterior
probability that it is good is at least one half. Abstentions carry no
evidence. Rules that look at the same kind of junk in different ways
corroborate each other; a vote of bad that nothing else supports counts as much
as its rule has proved right, no more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

WINDOW = 8
_SPACE = r"\x20\x09-\x0D"
RULES = ("symbols", "marked", "separators", "punctuation", "lines", "repeats", "variety", "letters", "capitals", "length", "shape", "glyphs")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once in each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` in a class (translate() would look up each character in a map)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside windows of :data:`WINDOW` words that occur twice or more, first ones included.

    Windows are compared by a 64-bit hash within one document. Sorted hashes
    bring equal windows together; sorted starts then give the covered words
    without listing them.
    """
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    ).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        kept = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k + 1)) | ((k > 0) & same(x, F.get(pairs, F.greatest(k - 1, F.lit(0))))))
        return let(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, twice))

    return let(hashes, count)


def features(text: Column) -> Column:
    """A struct of counts over the whole text (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    long = lambda c: c.cast("long")

    def of_lines(x: Column) -> Column:
        ends = F.filter(x, lambda line: F.rtrim(line).rlike(r"[.!?:;,…\"')\]]$"))
        return F.struct(long(F.size(x)).alias("n"), long(F.size(ends)).alias("ends"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def of_words(w: Column) -> Column:
        return let(
            let(lines, of_lines),
            lambda x: F.struct(
                long(F.size(w)).alias("n_words"),
                long(F.length(F.array_join(w, ""))).alias("word_chars"),
                _count(text, "#*$%&|<>").alias("n_symbols"),
                x["dup"].alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                x["n"].alias("n_lines"),
                x["ends"].alias("n_ends"),
                _count(text, "A-Z").alias("n_upper"),
                _count(text, "a-z").alias("n_lower"),
                _count(text, "0-9").alias("n_digits"),
                long(F.size(F.array_distinct(w))).alias("n_distinct"),
                long(F.regexp_count(text, F.lit(f"(?<![{_SPACE}])[#*$%&|<>!]{{2,}}(?=[{_SPACE}]|$)"))).alias("n_marked"),
                long(F.regexp_count(text, F.lit(f"(?<=[{_SPACE}])[#*$%&|<>]+(?=[{_SPACE}])"))).alias("n_separators"),
                _count(text, r"!-/:-@\x5B-`{-~").alias("n_punct"),
            ),
        )

    return let(words, of_words)


def base_failed(f) -> Column:
    return (f("n_words") < 20) | (100 * f("n_repeat_words") > 30 * f("n_words"))


def votes(f) -> list[Column]:
    """Each rule's vote: 1 bad, 0 good, null abstains. ``f`` gives a count by its name."""
    n, chars, letters = f("n_words"), f("word_chars"), f("n_upper") + f("n_lower")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 1).when(good, 0)

    short = n <= 400  # the share of distinct words falls with length
    return [
        vote(100 * f("n_symbols") > 20 * n, 100 * f("n_symbols") <= 5 * n),
        vote(100 * f("n_marked") > 20 * n, 100 * f("n_marked") <= 2 * n),
        vote(100 * f("n_separators") > 15 * n, 100 * f("n_separators") <= 2 * n),
        vote(100 * f("n_punct") > 45 * n, 100 * f("n_punct") <= 35 * n),
        vote(100 * f("n_dup_lines") > 50 * f("n_lines"), 100 * f("n_dup_lines") <= 10 * f("n_lines")),
        vote(100 * f("n_repeat_words") > 20 * n, 100 * f("n_repeat_words") <= 5 * n),
        vote((100 * f("n_distinct") < 30 * n) & short, (100 * f("n_distinct") >= 40 * n) & short),
        vote((chars > 12 * n) | (chars < 3 * n), (chars <= 9 * n) & (2 * chars >= 7 * n)),
        vote(2 * f("n_upper") > letters, 4 * f("n_upper") <= letters),
        vote(n < 40, n >= 80),
        vote(10 * f("n_ends") < 4 * f("n_lines"), 2 * f("n_ends") >= f("n_lines")),
        vote(10 * f("n_digits") > chars, 50 * f("n_digits") <= chars),
    ]


@dataclass(frozen=True)
class Model:
    """Prior of bad, and for each rule how often it says bad of good and of bad documents when it votes."""

    prior: float
    false_alarm: tuple[float, ...]
    recall: tuple[float, ...]

    def log_odds(self, pattern) -> float:
        """Log odds of bad for votes 1, 0 or None."""
        out = math.log(self.prior / (1 - self.prior))
        for v, a, r in zip(pattern, self.false_alarm, self.recall):
            out += 0 if v is None else math.log(r / a) if v else math.log((1 - r) / (1 - a))
        return out

    def column(self, ballots: list[Column]) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, a, r in zip(ballots, self.false_alarm, self.recall):
            out = out + F.when(v == 1, math.log(r / a)).when(v == 0, math.log((1 - r) / (1 - a))).otherwise(0.0)
        return out


def fit(patterns: list[tuple[tuple, int]], rules: int, rounds: int = 200) -> Model:
    """Expectation-maximisation over (votes, count) pairs.

    Recalls and false alarms are posterior means under the prior of a few
    imagined votes (a rule that says bad of one in fifty good and of one in
    three bad documents), which decides only where a rule hardly ever speaks.
    The classes can't change places: a rule's recall is at least its false
    alarm, and bad documents are half of all at most.
    """
    total = sum(c for _, c in patterns) or 1
    weights = [0.02 + 0.96 * min(1.0, sum(v == 1 for v in p) / 3) for p, _ in patterns]
    model = Model(0.1, (0.02,) * rules, (1 / 3,) * rules)
    for _ in range(rounds):
        bad = sum(w * c for w, (_, c) in zip(weights, patterns))
        alarm, recall = [], []
        for k in range(rules):
            said = [(p[k], c, w) for (p, c), w in zip(patterns, weights) if p[k] is not None]
            good_n, bad_n = sum(c * (1 - w) for _, c, w in said), sum(c * w for _, c, w in said)
            a = (sum(c * (1 - w) for v, c, w in said if v) + 0.2) / (good_n + 10)
            r = (sum(c * w for v, c, w in said if v) + 1) / (bad_n + 3)
            alarm.append(min(a, 0.5))
            recall.append(min(max(r, alarm[-1]), 0.999))
        model = Model(min(0.5, max(1e-3, (bad + 1) / (total + 10))), tuple(alarm), tuple(recall))
        weights = [1 / (1 + math.exp(-model.log_odds(p))) for p, _ in patterns]
    return model


def learn(counted: DataFrame) -> Model:
    """Fits the model to a frame with the columns of :func:`features`."""
    names = [f"v_{r}" for r in RULES]
    ballots = counted.select(*(v.alias(n) for v, n in zip(votes(F.col), names)))
    rows = ballots.groupBy(*names).count().collect()  # at most 3 ** len(RULES), however many documents
    return fit(sorted(((tuple(r[:-1]), r[-1]) for r in rows), key=str), len(RULES))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, p_good and kept.

    Null and empty texts have no words and fail the base rule. Repeated rows
    and null ids are returned as they are; other columns are ignored; an empty
    table gives no rows.
    """
    counted = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), features(F.col(text_col)).alias("f")).select("doc_id", "f.*"), "quality")
    model = learn(counted)
    odds = model.column(votes(F.col))
    return counted.withColumns({"base_failed": base_failed(F.col), "p_good": 1 / (1 + F.exp(odds))}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rule or the model rejects; all columns stay.

    Null and empty texts have no words and go. Repeated rows and rows without
    an id are judged each by its text; an empty table stays empty. Columns may
    have any names. The counts are made once and written beside the rows.
    """
    name = fresh("_quality", docs.columns)
    counted = materialize(docs.withColumn(name, features(F.col(text_col))), "quality")
    model = learn(counted.select(F.col(name).alias("_f")).select("_f.*"))
    get = lambda x: F.col(name)[x]
    return counted.where(~base_failed(get) & (model.column(votes(get)) <= 0)).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
