"""Quality rules: fixed base rules and a calibrated classifier.

The base rules count words, symbols, repeated lines and repeated windows of words. The classifier is logistic
regression over hashed word n-grams (one and two words) and character n-grams (four bytes), each as
a share of the text, learned by AdaGrad on labelled rows and calibrated by Platt scaling on rows kept
apart. Texts are scored whole in Arrow batches and held against fixed thresholds.

Learning uses at most MAX_ROWS labelled documents, chosen by a hash of doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, doc_columns, map_text, ship_package
from corpusloom.llm.textkernel import SPACE, Texts, distinct, exact_keys, key_hash, mix, running, spans
from corpusloom.llm.training import labelled, sample, sigmoid

#: Fixed thresholds of the base rules and of the verdict.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW, KEEP_AT = 10, 20, 5, 0.5
BITS, CHARS, EPOCHS, RATE = 17, 4, 6, 0.5
MAX_ROWS = 5000
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True


def _repeats(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows of ``size`` words from ``at`` on are found twice or more in their text; lo, hi: exact keys of all words."""
    h = own.astype(np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xA24BAED4963EE407) + key_hash(lo[at + k], hi[at + k]))
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    met = np.flatnonzero(h[a] == h[b])
    a, b = a[met], b[met]
    alike = own[a] == own[b]
    for k in range(size):
        i, j = at[a] + k, at[b] + k
        alike &= (lo[i] == lo[j]) & (hi[i] == hi[j])
    if not alike.all():  # equal hashes of different windows: number the windows by the words themselves
        word = distinct(lo, hi)[1]
        number = own
        for k in range(size):
            number = np.unique(np.stack([number, word[at + k]], 1), axis=0, return_inverse=True)[1].ravel()
        return np.bincount(number)[number] > 1
    out = np.zeros(len(at), bool)
    out[a] = out[b] = True
    return out


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text. Lines and windows are compared by their bytes."""
    t = Texts(texts)
    starts, ends, owner = t.words()
    between = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[t.starts])
    solid = ~SPACE[t.data]
    out = {"n_words": np.bincount(owner, minlength=t.n), "word_chars": between(solid & ((t.data & 0xC0) != 0x80)), "n_symbols": between(_SYMBOL[t.data])}

    dup = []
    for text in texts:
        full = [x for x in text.split(b"\n") if x.strip(_BLANKS)] if b"\n" in text else ()
        dup.append(len(full) - len(set(full)))
    out["n_dup_lines"] = np.array(dup, np.int64)

    size = REPEAT_WINDOW
    at = np.arange(max(0, len(starts) - size + 1))
    at = at[owner[at] == owner[at + size - 1]] if len(at) else at
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        hit = at[_repeats(*exact_keys(t.data, starts, ends, {}), at, owner[at], size)]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=t.n)
    return out


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, texts they come from): of word n-grams, and of character n-grams in a second range."""
    t = Texts(texts)
    starts, ends, owner = t.words()
    sums = running(t.data.astype(np.uint64) + np.uint64(1))
    w = spans(sums, starts, ends)
    same = owner[1:] == owner[:-1]
    pair = mix(w[:-1] * np.uint64(0x632BE59BD9B4E019) + w[1:])[same]
    words = np.concatenate([w, pair]) >> np.uint64(64 - BITS)
    at = np.arange(max(0, len(t.data) - CHARS))
    own = np.repeat(np.arange(t.n), t.lengths + 1)[: len(at)]
    at, own = (at[inside], own[inside]) if len(at) and len(inside := np.flatnonzero(at + CHARS <= t.starts[own + 1] - 1)) else (at[:0], own[:0])
    chars = (spans(sums, at, at + CHARS) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
    return [(words.astype(np.int64), np.concatenate([owner, owner[:-1][same]])), (chars.astype(np.int64), own)]


def feature_rows(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct places, then as many shares in units of 2**-24."""
    keys, shares = [], []
    for ids, owner in features(texts):
        k, n = np.unique((owner << (BITS + 1)) | ids, return_counts=True)
        total = np.bincount(owner, minlength=len(texts))
        keys.append(k)
        shares.append(n / total[k >> (BITS + 1)])
    k, s = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(k)
    k, s = k[order], s[order]
    cuts = np.searchsorted(k, np.arange(1, len(texts)) << (BITS + 1))
    ids = np.split((k & ((2 << BITS) - 1)).astype(np.uint32), cuts)
    return [np.concatenate([a, (b * (1 << 24)).astype(np.uint32)]) for a, b in zip(ids, np.split(s, cuts), strict=True)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float

    def raw(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for ids, owner in features(texts):
            n = np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, self.weights[ids], minlength=len(texts)) / np.maximum(n, 1)
        return total

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.shift)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """AdaGrad on four of five rows, Platt scaling on the fifth; one class or none gives a constant."""
    w = np.zeros(2 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(w.astype(np.float32), 0.0, 1.0, 35.0 if not len(y) or y[0] else -35.0)
    parts = [(x[: len(x) // 2], x[len(x) // 2 :] / (1 << 24) * 100) for x in rows]
    square, bias, bias_square = np.full(2 << BITS, 1e-6), 0.0, 1e-6
    learn = [i for i in range(len(y)) if i % 5]
    for _ in range(EPOCHS):
        for i in learn:
            ids, x = parts[i]
            g = float(sigmoid(bias + w[ids] @ x)) - y[i]
            square[ids] += (g * x) ** 2
            w[ids] -= RATE * 0.1 * g * x / np.sqrt(square[ids])
            bias_square += g * g
            bias -= RATE * g / np.sqrt(bias_square)
    kept = range(0, len(y), 5)
    raw, target = np.array([bias + w[parts[i][0]] @ parts[i][1] for i in kept]), y[list(kept)]
    return Model((w * 100).astype(np.float32), bias, *platt(raw, target))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that calibrates raw scores: Newton's method with step halving, targets drawn in."""
    slope, shift = 1.0, 0.0
    if y.min() == y.max():
        return slope, shift
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * raw + b
        return float(np.sum(np.logaddexp(0, z) - goal * z))

    now = loss(slope, shift)
    for _ in range(100):
        p = sigmoid(slope * raw + shift)
        v = p * (1 - p)
        z = np.stack([raw, np.ones(len(raw))])
        step = np.linalg.solve((z * v) @ z.T + 1e-9 * np.eye(2), z @ (p - goal))
        size = 1.0
        while size > 1e-10 and (new := loss(slope - size * step[0], shift - size * step[1])) > now - 1e-9:
            size /= 2
        if size <= 1e-10:
            break
        slope, shift, now = slope - size * step[0], shift - size * step[1], new
    return max(float(slope), 1e-9), float(shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    ship_package(docs.sparkSession)
    rows, y, _ = sample(labelled(docs, labels, "quality", max_rows), feature_rows)
    return fit(rows, y)


def op1_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and quality (the calibrated probability) per row.

    Null and empty texts have no words and fail the base rules. Without labels of both classes the
    verdict is the one class there is, or to keep. Repeated rows come repeated, each with the same numbers; a null doc_id
    stays null and teaches nothing. Texts are scored whole, however long. Further columns are ignored, whatever their names. An empty table gives an empty result.
    """
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**(BITS + 1) weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        base = base_counts(texts)
        p = held.value.probability(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[n].astype(np.int64)) for n in names), pa.array(p)], ["doc_id", *names, "quality"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", quality double"
    rows = map_text(doc_columns(docs), run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("quality") >= KEEP_AT)).alias("kept"), "quality")
