"""Personal data: exact base patterns plus a character-level BiLSTM-CRF tagger.

The tagger is trained in numpy on windows of a bounded sample of documents,
labelled with the spans of the base patterns and with disguised copies of them
(``name (at) host dot org``, other separators, numbers without their plus
sign), so it finds spans that no base pattern does. Texts are read as
overlapping windows; their scores are averaged where windows overlap, the
nearer a window's middle the heavier, and each stretch of touching windows is
decoded once as a whole, so no span depends on where a window ends. Every kind
of span has a digit, an ``@``, a dot between letters or the word ``dot``:
windows without any of these hold none and are not run.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, table

#: Kinds, in the order that sorts equal starts.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- base patterns ---------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DOT = re.compile("(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
_TRIGGER = re.compile("[0-9@]|(?<=[A-Za-z])[.](?=[A-Za-z])|" + _DOT.pattern)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their ``@``: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def _low(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start and kind; a match that fails its check is dropped."""
    out: list[Span] = [("email", *m) for m in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_low, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- tagger ----------------------------------------------------------------

WINDOW, STRIDE, HIDDEN, TAGS = 96, 48, 16, 1 + 2 * len(KINDS)
#: Bounds of the training sample: documents, characters of one of them, windows.
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_WINDOWS = 1_500, 20_000, 1_500
#: Updates that small samples get at least.
STEPS = 400
_SINGLE = "@.-+()_%,:/=\"' []dotaDOTA"
_CLASSES = len(_SINGLE) + 8


def _class_table() -> np.ndarray:
    """Class of each ASCII character; entry 128 is that of all others. Class 0 is padding."""
    out = np.full(129, 1, dtype=np.int64)
    for c in "0123456789":
        out[ord(c)] = 2
    for c in "abcdefghijklmnopqrstuvwxyz":
        out[ord(c)] = 3 if c <= "f" else 4
        out[ord(c.upper())] = 5
    for i, c in enumerate(_SINGLE):
        out[ord(c)] = 8 + i
    out[[9, 10, 11, 12, 13]], out[128] = 6, 7
    return out


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]


#: Classes of letters, and of the dot.
_LETTERS = np.isin(np.arange(_CLASSES), [*(_TABLE[ord(c)] for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")])
_PERIOD, _AT = int(_TABLE[ord(".")]), int(_TABLE[ord("@")])


def active_windows(codes: np.ndarray, text: str) -> np.ndarray:
    """Starts of the windows that hold a digit, ``@``, a dot between letters or the word ``dot``."""
    n = max(1, -(-max(0, len(codes) - (WINDOW - STRIDE)) // STRIDE))
    hit = (codes == 2) | (codes == _AT)
    if len(codes) > 2:
        hit[1:-1] |= (codes[1:-1] == _PERIOD) & _LETTERS[codes[:-2]] & _LETTERS[codes[2:]]
    places = np.r_[np.flatnonzero(hit), np.array([m.start() for m in _DOT.finditer(text)], dtype=np.int64)]
    blocks = np.zeros(n + 1, dtype=bool)
    blocks[np.minimum(places // STRIDE, n)] = True
    return np.flatnonzero(blocks[:n] | blocks[1:]) * STRIDE


def cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows of ``codes`` at ``starts``, padded with class 0."""
    padded = np.zeros(len(codes) + WINDOW, dtype=np.int64)
    padded[: len(codes)] = codes
    return padded[starts[:, None] + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Tagger:
    """Two LSTMs over character classes, a linear layer, and CRF transitions; ``p`` holds all weights."""

    p: dict[str, np.ndarray]

    def lstm(self, way: str, codes: np.ndarray, keep: bool = False):
        """Hidden states (step, window, unit) of one direction, and what back-propagation needs."""
        table, u = self.p[f"{way}x"], self.p[f"{way}h"]
        n, steps = codes.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = table[codes[:, t]] + h @ u
            gates, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, kept

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (window, step, tag)."""
        both = np.concatenate([self.lstm("f", codes)[0], self.lstm("b", codes)[0]], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def loss_gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood per window and its gradient."""
        p, (n, steps) = self.p, codes.shape
        states = {w: self.lstm(w, codes, True) for w in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        logit = both @ p["out"] + p["bias"]
        top = logit.max(2, keepdims=True)
        e, move, seen = np.exp(logit - top), np.exp(p["trans"]), tags.T
        alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.empty((steps, n, 1), np.float32)
        for t in range(steps):
            x = e[t] * (alpha[t - 1] @ move if t else 1.0)
            norm[t] = x.sum(1, keepdims=True)
            alpha[t] = x / norm[t]
        beta[-1] = 1.0
        for t in range(steps - 2, -1, -1):
            beta[t] = (e[t + 1] * beta[t + 1]) @ move.T / norm[t + 1]
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        rows = np.arange(n)
        gold = sum(logit[t, rows, seen[t]].sum() for t in range(steps)) + p["trans"][seen[:-1], seen[1:]].sum()
        loss = float((np.log(norm) + top).sum() - gold) / n
        d_trans = sum(alpha[t - 1].T @ (e[t] * beta[t] / norm[t]) for t in range(1, steps)) * move
        np.subtract.at(d_trans, (seen[:-1].ravel(), seen[1:].ravel()), 1.0)
        d = post
        for t in range(steps):
            d[t, rows, seen[t]] -= 1.0
        d /= n
        grad = {"out": np.einsum("tnh,tnk->hk", both, d), "bias": d.sum((0, 1)), "trans": d_trans / n}
        d_both, hot = d @ p["out"].T, np.eye(_CLASSES, dtype=d.dtype)[codes]
        for w in "fb":
            d_out = d_both[:, :, :HIDDEN] if w == "f" else d_both[:, :, HIDDEN:]
            table, u = np.zeros_like(p[f"{w}x"]), np.zeros_like(p[f"{w}h"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, before, i, f, o, g, tc in reversed(states[w][1]):
                dh = dh + d_out[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                table += hot[:, t].T @ dz
                u += h.T @ dz
                dh, dc = dz @ p[f"{w}h"].T, dc * f
            grad[f"{w}x"], grad[f"{w}h"] = table, u
        return loss, grad

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag sequence of each segment of tag scores."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(segments)
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        trans = self.p["trans"].astype(np.float32)
        while order:
            longest = len(segments[order[-1]])
            batch = [order.pop() for _ in range(min(len(order), max(1, min(256, 400_000 // longest))))]
            n = len(batch)
            scores = np.zeros((longest, n, TAGS), np.float32)
            mask = np.zeros((longest, n), dtype=bool)
            for j, k in enumerate(batch):
                scores[: len(segments[k]), j], mask[: len(segments[k]), j] = segments[k], True
            best, back = scores[0], np.zeros((longest, n, TAGS), np.int8)
            for t in range(1, longest):
                x = best[:, :, None] + trans
                back[t] = x.argmax(1)
                best = np.where(mask[t][:, None], x.max(1) + scores[t], best)
            tag, rows = best.argmax(1), np.arange(n)
            path = np.zeros((longest, n), dtype=np.int64)
            for t in range(longest - 1, -1, -1):
                path[t] = tag
                tag = np.where(mask[t], back[t, rows, tag], tag) if t else tag
            for j, k in enumerate(batch):
                out[k] = path[: len(segments[k]), j]
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans that the tagger sees in each text; implausible ones are left out."""
        coded = [(k, classes(t)) for k, t in enumerate(texts) if _TRIGGER.search(t)]
        starts = [active_windows(c, texts[k]) for k, c in coded]
        cuts = [cut(c, s) for (_, c), s in zip(coded, starts)]
        weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]
        out: list[list[Span]] = [[] for _ in texts]
        segments: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        pending = [(i, j) for i, s in enumerate(starts) for j in range(len(s))]
        flat = np.concatenate(cuts) if cuts else np.empty((0, WINDOW), dtype=np.int64)
        scored = [self.logits(flat[i : i + 1024]) for i in range(0, len(pending), 1024)]
        logits, at = np.concatenate(scored) if scored else np.empty((0, WINDOW, TAGS), np.float32), 0
        for (k, codes), s in zip(coded, starts):
            own = logits[at : at + len(s)]
            at += len(s)
            for group in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s) >= WINDOW) + 1):
                first, end = s[group[0]], min(len(codes), s[group[-1]] + WINDOW)
                total, mass = np.zeros((s[group[-1]] + WINDOW - first, TAGS), np.float32), np.zeros((s[group[-1]] + WINDOW - first, 1), np.float32)
                for j in group:
                    a = s[j] - first
                    total[a : a + WINDOW] += own[j] * weight
                    mass[a : a + WINDOW] += weight
                segments.append((total / mass)[: end - first])
                owner.append((k, int(first)))
        for (k, first), path in zip(owner, self.decode(segments)):
            out[k] += [x for x in runs(path, first) if plausible(x, texts[k])]
        return out


def runs(path: np.ndarray, first: int) -> list[Span]:
    """Spans of a tag sequence that starts at character ``first``."""
    out: list[Span] = []
    start = kind = None
    tags = path.tolist()
    for t, tag in enumerate([*tags, 0]):
        if start is not None and tag != 2 * kind + 2:
            out.append((KINDS[kind], first + start, first + t))
            start = None
        if tag and start is None:
            start, kind = t, (tag - 1) // 2
    return out


def plausible(span: Span, text: str) -> bool:
    """Whether a span can be of its kind at all: checksum, ranges and parts, however they are written."""
    kind, a, b = span
    part = text[a:b]
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]\W*(@|(?<![A-Za-z])at(?![A-Za-z]))\W*[A-Za-z0-9]", part, re.IGNORECASE)) and ("." in part or bool(_DOT.search(part)))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return len(numbers) == 4 and all(map(_low, numbers)) if kind == "ip" else 9 <= len(digits) <= 15


def disguise(kind: str, part: str, rng: np.random.Generator) -> str:
    """A base span as people write it who don't want it found."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = "".join(_DIGIT.findall(part))
    if kind == "email":
        name, _, host = part.partition("@")
        return name + pick(" at ", " (at) ", "[at]", " [at] ", "(at)", " AT ", " @ ", "@") + pick(" dot ", " (dot) ", "[dot]", "(dot)", " DOT ", ".").join(host.split("."))
    if kind == "ip":
        return pick(" . ", "[.]", " dot ", "(.)", " ", "[dot]").join(part.split("."))
    if kind == "card":
        return pick(".", "/", "_", "  ", " - ", ", ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 {a} {b} {c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"{a}/{b}-{c}")


def disguised(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """``text`` with every span that overlaps none before it disguised, and where they are then."""
    out, found, at, size = [], [], 0, 0
    for kind, a, b in spans:
        if a >= at:
            new = disguise(kind, text[a:b], rng)
            out += [text[at:a], new]
            size += a - at
            found.append((kind, size, size + len(new)))
            at, size = b, size + len(new)
    return "".join([*out, text[at:]]), found


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    """Tags of the window at ``start``; of overlapping spans, the first."""
    out = np.zeros(WINDOW, dtype=np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if b > 0 and a < WINDOW and not out[max(0, a) : b].any():
            out[max(0, a) : b] = 2 * KINDS.index(kind) + 2
            if a >= 0:
                out[a] -= 1
    return out


def fit(texts: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Trains on the windows of ``texts`` that hold a base span, plain and disguised twice, and as many others at most."""
    rng = np.random.default_rng(seed)
    some: list[tuple[np.ndarray, np.ndarray]] = []
    none: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        spans = base_spans(text)
        for text, spans in [(text, spans), *(disguised(text, spans, rng) for _ in range(2 if spans else 0))]:  # noqa: PLW2901
            codes = classes(text)
            for s in active_windows(codes, text).tolist() if _TRIGGER.search(text) else ():
                tags = tags_of(spans, s)
                (some if tags.any() else none).append((cut(codes, np.array([s]))[0], tags))
    some = some[:: len(some) // TRAIN_WINDOWS + 1]
    none = none[:: len(none) // max(1, len(some)) + 1]
    scale = 0.3
    p = {f"{w}x": rng.normal(0, scale, (_CLASSES, 4 * HIDDEN)) for w in "fb"} | {f"{w}h": rng.normal(0, scale, (HIDDEN, 4 * HIDDEN)) for w in "fb"}
    p |= {"out": rng.normal(0, scale, (2 * HIDDEN, TAGS)), "bias": np.r_[2.0, np.zeros(TAGS - 1)], "trans": np.zeros((TAGS, TAGS))}
    for k in range(len(KINDS)):
        p["trans"][[t for t in range(TAGS) if t not in (2 * k + 1, 2 * k + 2)], 2 * k + 2] = -8.0
    p = {k: v.astype(np.float32) for k, v in p.items()}
    for w in "fb":
        p[f"{w}x"][:, HIDDEN : 2 * HIDDEN] += 1.0  # forget less at first
    tagger, windows = Tagger(p), some + none
    epochs = max(epochs, min(60, -(-STEPS * batch // max(1, len(windows)))))
    if not some:
        p["bias"][0] = 30.0  # nothing to learn from: no spans of its own
        return tagger
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            part = [windows[j] for j in order[i : i + batch]]
            _, grad = tagger.loss_gradient(np.stack([c for c, _ in part]), np.stack([t for _, t in part]))
            size = float(np.sqrt(sum((g**2).sum() for g in grad.values())))
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def learn(docs: DataFrame, text_col: str = "text") -> Tagger:
    """Fits on at most :data:`TRAIN_DOCUMENTS` distinct texts with a trigger, in the order of a hash of the text.

    Texts of over :data:`TRAIN_CHARS` characters are not fitted on. One task
    on an executor holds the sample and trains; the driver gets the weights.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(_TRIGGER.pattern) & (F.length("t") <= TRAIN_CHARS))
    keys = texts.select(F.xxhash64("t").alias("k")).distinct().orderBy("k").limit(TRAIN_DOCUMENTS)
    chosen = texts.withColumn("k", F.xxhash64("t")).join(F.broadcast(keys), "k").dropDuplicates(["k"])

    def train(batches):
        rows = sorted((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t in rows]).p)], pa.binary())], names=["p"])

    made = chosen.select("k", "t").repartition(1).mapInArrow(train, "p binary").collect()
    return Tagger(pickle.loads(bytes(made[0]["p"]))) if made else fit([])


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; spans of the tagger that touch a base span are left out."""
    out = []
    for text, more in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        out.append((base, ordered(base + [x for x in more if not any(x[1] < b and a < x[2] for _, a, b in base)])))
    return out


def in_parts(column: pa.Array, chars: int = 4_000_000):
    """Texts of an Arrow column, in lists of a few million characters."""
    held, size = [], 0
    for v in column:
        data = v.as_py()
        text = (data or b"").decode("utf-8", "replace")
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, columns of :data:`REPORT`; offsets are code points, ends exclusive.

    Null and empty texts have no spans. Repeated rows are all returned; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for texts in in_parts(batch.column(1)):
            for base, every in all_spans(texts, model.value):
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(every)))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[c.split()[0] for c in REPORT.split(", ")])

    return map_rows(as_bytes(docs, id_col, text_col), lambda: lambda b: step(b) if b.num_rows else None, REPORT)


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced; null stays null, other columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        new = [redact_text(t, every) for texts in in_parts(column.cast(pa.binary())) for t, (_, every) in zip(texts, all_spans(texts, model.value))]
        kept = pa.array([n if v.is_valid else None for n, v in zip(new, column)], column.type)
        return pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_rows(docs, lambda: step, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
