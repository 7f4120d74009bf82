"""Toxic span tagging with a linear-chain conditional random field.

Two states (clean, toxic) run over the words of a text. The features of a word
are the word itself and its first letters; those in the lexicon, which favour
toxic or clean documents, have a weight. Forward and backward run over blocks
of words of many texts at once: the product of a block's transitions joins it
to the next, so the marginals are those of the whole chain, whatever its length.
The noisy-or of all words' marginals, calibrated on the training documents
together with the number of words, is the document's score.

Training words are labelled from document labels: the words that clearly favour
toxic documents are the toxic words of those. Only a bounded sample of labelled
documents is used for the fit; every document is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, alnum_words, as_bytes, map_rows, table

#: Bounds of the training sample: labelled documents, words of one of them (longer ones are not fitted on, but scored whole), windows.
TRAIN_DOCUMENTS, TRAIN_WORDS, TRAIN_WINDOWS = 6_000, 20_000, 12_000
LEXICON = 4_000
STEPS = 24
#: Features that favour toxic documents this much (log ratio) are in the lexicon, or mark toxic words.
IN_LEXICON, MARKED, SEEN = 1.0, 2.0, 3
THRESHOLD = 0.3
#: Words in a block of the chain, and words of all texts worked on at a time.
BLOCK, TOGETHER = 64, 400_000


def parts(word: bytes) -> list[bytes]:
    """A word's features: itself, and its first four and five bytes if it is longer."""
    return [word, *(word[:n] + b"*" for n in (4, 5) if len(word) > n)]


@dataclass
class Crf:
    """``trans[a, b]`` from state a to b, ``bias`` of the toxic state, ``weight`` of each lexicon feature for it.

    ``curve`` calibrates a document's evidence: weights of its columns and a constant.
    """

    lexicon: dict[bytes, int]
    trans: np.ndarray
    bias: float
    weight: np.ndarray
    curve: tuple[float, ...] = (1.0, 0.0, 0.0)

    def __reduce__(self):
        return Crf, (self.lexicon, self.trans, self.bias, self.weight, self.curve)

    def __post_init__(self):
        weights = {f: float(self.weight[i]) for f, i in self.lexicon.items()}

        def emission(words: list[bytes]) -> list[float]:
            found = (sum(weights.get(f, 0.0) for f in parts(w)) for w in words)
            return [math.exp(max(-30.0, min(30.0, x))) if x else 1.0 for x in found]

        self.cache = BoundedCache(emission)

    def potentials(self, texts: list[list[bytes]]) -> np.ndarray:
        """Potentials of the toxic state at each word of the texts, one text after another."""
        return np.array([x for words in texts for x in map(self.cache.prepare(set(words)).__getitem__, words)], dtype=float)

    def marginals(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Probability of the toxic state at each word of each text."""
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        found = chain(np.exp(self.trans + np.array([0.0, self.bias])), math.exp(self.bias), self.potentials(texts), sizes)
        return np.split(found, np.cumsum(sizes)[:-1]) if len(texts) else []

    def tag(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """For each text, score from 0 to 1 and (word number, probability) of the words likelier toxic than not."""
        out, held, total = [], [], 0

        def flush() -> None:
            nonlocal held, total
            each = self.marginals(held)
            scores = self.calibrate(np.array([evidence(p) for p in each]).reshape(-1, 2)).tolist()
            for s, p in zip(scores, each):
                at = np.flatnonzero(p >= 0.5)
                out.append((s, list(zip(at.tolist(), p[at].tolist()))))
            held, total = [], 0

        for text in texts:
            held.append(alnum_words(text))
            total += len(held[-1])
            if total >= TOGETHER:
                flush()
        if held:
            flush()
        return out

    def calibrate(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve[:-1]) + self.curve[-1], -30, 30)))


def chain(step: np.ndarray, first: float, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals of the toxic state at each word of several texts.

    ``step`` holds the transition potentials, ``emit`` each word's potential of
    the toxic state, ``sizes`` the words of each text; ``first`` is what the
    toxic state has at the first word besides. Rows of :data:`BLOCK` words are
    multiplied up side by side, then joined in turn within each text, then
    filled in side by side, so no text is too long and none is cut.
    """
    if not len(emit):
        return np.empty(0)
    rows = -(-sizes // BLOCK)
    n = int(rows.sum())
    place = np.arange(len(emit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, column = np.repeat(np.cumsum(rows) - rows, sizes) + place // BLOCK, place % BLOCK
    e, live = np.ones((BLOCK, n)), np.zeros((BLOCK, n), dtype=bool)
    e[column, row], live[column, row] = emit, True
    begins = np.zeros(n + 1, dtype=bool)
    begins[(np.cumsum(rows) - rows)[rows > 0]] = True
    begins[n] = True
    opening = np.flatnonzero(begins[:n])
    (m00, m01), (m10, m11) = step.tolist()

    def move(t: int) -> tuple[np.ndarray, ...]:
        on = live[t]
        p, q, r, s = np.where(on, m00, 1.0), np.where(on, m01 * e[t], 0.0), np.where(on, m10, 0.0), np.where(on, m11 * e[t], 1.0)
        if t == 0:
            p[opening], q[opening], r[opening], s[opening] = 1.0, first * e[0, opening], 0.0, 0.0
        return p, q, r, s

    a, b, c, d = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(BLOCK):
        p, q, r, s = move(t)
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    product, starts = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())), begins.tolist()
    into, x, y = [], 1.0, 0.0
    for k in range(n):
        if starts[k]:
            x, y = 1.0, 0.0
        into.append((x, y))
        p, q, r, s = product[k]
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    out_of, x, y = [(1.0, 1.0)] * n, 1.0, 1.0
    for k in range(n - 1, -1, -1):
        if starts[k + 1]:
            x = y = 1.0
        out_of[k] = (x, y)
        p, q, r, s = product[k]
        x, y = p * x + q * y, r * x + s * y
        x, y = x / (x + y), y / (x + y)
    x, y = np.array(into).T
    clean, toxic = np.empty((BLOCK, n)), np.empty((BLOCK, n))
    for t in range(BLOCK):
        p, q, r, s = move(t)
        x, y = x * p + y * r, x * q + y * s
        total = x + y
        clean[t], toxic[t] = x, y = x / total, y / total
    x, y = np.array(out_of).T
    for t in range(BLOCK - 1, -1, -1):
        u, v = clean[t] * x, toxic[t] * y
        toxic[t] = v / (u + v)
        p, q, r, s = move(t)
        x, y = p * x + q * y, r * x + s * y
        total = x + y
        x, y = x / total, y / total
    return toxic[column, row]


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Noisy-or of all words' marginals as bounded log odds, and the logarithm of the number of words."""
    clean = float(np.log1p(-np.minimum(p, 0.999999)).sum())
    return min(12.0, max(-12.0, math.log(max(-math.expm1(clean), 1e-9)) - clean)), math.log1p(len(p))


def favoured(texts: list[list[bytes]], labels: list[int]) -> dict[bytes, float]:
    """Features by how much they favour toxic documents, or clean ones if less than 0 (log ratio of document shares)."""
    toxic, clean = Counter(), Counter()
    for words, y in zip(texts, labels):
        (toxic if y else clean).update({f for w in set(words) for f in parts(w)})
    n1, n0 = sum(labels) or 1, (len(labels) - sum(labels)) or 1
    ratio = {f: math.log((c + 0.1) / (n1 + 1)) - math.log((clean[f] + 0.5) / (n0 + 1)) for f, c in toxic.items() if c >= SEEN}
    ratio |= {f: math.log((toxic[f] + 0.5) / (n1 + 1)) - math.log((c + 0.1) / (n0 + 1)) for f, c in clean.items() if f not in ratio and c >= SEEN}
    return ratio


def fit(texts: list[list[bytes]], labels: list[int], rounds: int = 60) -> Crf:
    """Trains on labelled documents; without toxic ones nothing is in the lexicon and all scores are low."""
    ratio = favoured(texts, labels)
    ranked = sorted((f for f in ratio if abs(ratio[f]) > IN_LEXICON), key=lambda f: (-abs(ratio[f]), f))[:LEXICON]
    lexicon = {f: i for i, f in enumerate(ranked)}
    marked = {f for f in ranked if ratio[f] > MARKED}
    numbers: dict[bytes, tuple[int, ...]] = {}  # lexicon features of each distinct word
    for words in texts:
        for w in words:
            if w not in numbers:
                numbers[w] = tuple(lexicon[f] for f in parts(w) if f in lexicon)
    spots = [(k, i) for k, words in enumerate(texts) for i in range(0, len(words), STEPS)]
    busy = [(k, i) for k, i in spots if any(numbers[w] for w in texts[k][i : i + STEPS])]
    idle = sorted(set(spots).difference(busy))
    chosen = busy[:: len(busy) // TRAIN_WINDOWS + 1]
    chosen += idle[:: len(idle) // max(1, min(len(chosen), TRAIN_WINDOWS - len(chosen)) + 1) + 1]
    windows = []
    for k, i in chosen:
        part = texts[k][i : i + STEPS]
        windows.append(([numbers[w] for w in part], [int(bool(labels[k]) and any(f in marked for f in parts(w))) for w in part]))
    crf = train(windows, lexicon, rounds)
    found = []
    for i in range(0, len(texts), 64):
        found += [evidence(p) for p in crf.marginals(texts[i : i + 64])]
    crf.curve = platt(found, labels)
    return crf


def train(windows: list[tuple[list[tuple[int, ...]], list[int]]], lexicon: dict[bytes, int], rounds: int) -> Crf:
    """Maximises the regularised likelihood of the window labels by Adam, all windows at once."""
    n, size = len(windows), len(lexicon)
    theta = np.zeros(size + 5)  # weights, bias, trans
    if not n or not size:
        return Crf({}, np.zeros((2, 2)), -4.0, np.zeros(0))
    tags, mask = np.zeros((STEPS, n), dtype=int), np.zeros((STEPS, n), dtype=bool)
    step_of, window_of, feature = [], [], []  # one entry for each lexicon feature of each word
    for j, (ids, y) in enumerate(windows):
        tags[: len(y), j], mask[: len(y), j] = y, True
        for t, found in enumerate(ids):
            step_of += [t] * len(found)
            window_of += [j] * len(found)
            feature += found
    cell, feature = np.array(step_of, dtype=int) * n + np.array(window_of, dtype=int), np.array(feature, dtype=int)
    seen = np.bincount(feature, weights=tags.ravel()[cell], minlength=size)
    seen_bias = float((tags[mask] == 1).sum())
    pair = mask[1:]
    seen_trans = np.bincount((tags[:-1] * 2 + tags[1:])[pair], minlength=4).astype(float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        weight, bias, trans = theta[:size], theta[size], theta[size + 1 :].reshape(2, 2)
        score = np.bincount(cell, weights=weight[feature], minlength=STEPS * n).reshape(STEPS, n) + bias  # of the toxic state
        e = np.exp(np.clip(score, -30, 30))
        tm = np.exp(trans)
        alpha, beta = np.zeros((STEPS, n, 2)), np.ones((STEPS, n, 2))
        alpha[0] = np.stack([np.ones(n), e[0]], 1)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for s in range(1, STEPS):
            x = alpha[s - 1] @ tm
            x[:, 1] *= e[s]
            alpha[s] = np.where(mask[s][:, None], x / x.sum(1, keepdims=True), alpha[s - 1])
        for s in range(STEPS - 2, -1, -1):
            x = beta[s + 1].copy()
            x[:, 1] *= e[s + 1]
            x = x @ tm.T
            beta[s] = np.where(mask[s + 1][:, None], x / x.sum(1, keepdims=True), 1.0)
        post = alpha * beta
        p1 = post[..., 1] / post.sum(-1)
        after = beta[1:].copy()
        after[..., 1] *= e[1:]
        joint = alpha[:-1, :, :, None] * tm * after[:, :, None, :]
        joint /= joint.sum((-1, -2), keepdims=True)
        grad = np.zeros_like(theta)
        grad[:size] = seen - np.bincount(feature, weights=p1.ravel()[cell], minlength=size)
        grad[size] = seen_bias - p1[mask].sum()
        grad[size + 1 :] = seen_trans - (joint * pair[..., None, None]).sum((0, 1)).ravel()
        grad -= theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(lexicon, theta[size + 1 :].reshape(2, 2), float(theta[size]), theta[:size])


def platt(x: list[tuple[float, ...]], labels: list[int], rounds: int = 60) -> tuple[float, ...]:
    """Weights (the first at least 0.05) and constant of a logistic curve from evidence to label, by Newton's method."""
    y = np.asarray(labels, dtype=float) * 0.98 + 0.01
    x1 = np.column_stack([np.asarray(x, dtype=float).reshape(len(y), 2), np.ones(len(y))])
    w, shrink = np.array([1.0, 0.0, 0.0]), np.array([0.01, 0.01, 1e-6])

    def loss(v: np.ndarray) -> float:
        z = x1 @ v
        return float((np.logaddexp(0, z) - y * z).sum() + (shrink * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (y - p) - shrink * w
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(shrink)
        d, now = np.linalg.solve(h, g), loss(w)
        scale = next((c for c in 0.5 ** np.arange(20) if loss(w + c * d) < now), 0.0)
        if not scale:
            break
        w = w + scale * d
    return (max(float(w[0]), 0.05), float(w[1]), float(w[2]))


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Fits on at most :data:`TRAIN_DOCUMENTS` labelled rows, none of them held out, in the order of a hash of their ids."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = usable.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("_y"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCUMENTS)
    rows = as_bytes(docs, id_col, text_col).join(F.broadcast(chosen), "_id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [alnum_words(t.as_py()) for t in batch.column(1)]
        fits = [i for i, w in enumerate(found) if len(w) <= TRAIN_WORDS]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(fits, pa.int64())), pa.array([b" ".join(found[i]) for i in fits], pa.binary()), batch.column(2).take(pa.array(fits, pa.int64())).cast(pa.int64())],
            names=["_id", "words", "y"],
        )

    sample = sorted({(r["_id"], bytes(r["words"]), int(r["y"] > 0)) for r in map_rows(rows, lambda: step, "_id long, words binary, y long").toLocalIterator()})
    shared: dict[bytes, bytes] = {}  # one object for each distinct word
    return fit([[shared.setdefault(x, x) for x in w.split()] for _, w, _ in sample], [y for _, _, y in sample])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, spans (word ranges of toxic spans with their highest marginal).

    Null and empty texts have the score of a text without toxic words.
    Repeated rows are all scored; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, spans = [], []
        for s, found in model.value.tag([t.as_py() for t in batch.column(1)]):
            runs: list[dict] = []
            for i, p in found:
                if runs and runs[-1]["end"] == i:
                    runs[-1].update(end=i + 1, p=max(p, runs[-1]["p"]))
                else:
                    runs.append({"start": i, "end": i + 1, "p": p})
            scores.append(s)
            spans.append(runs)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, SPANS)], names=["doc_id", "score", "spans"])

    return map_rows(as_bytes(docs, id_col, text_col), lambda: step, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )
