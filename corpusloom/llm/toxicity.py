"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. Features are single words, pairs of neighbours and
pairs with one word between, hashed to 2**BITS places; each counts once a document. FTRL-proximal keeps a rate per
coordinate and sets weak coordinates to exactly zero. A first pass with a strong L1 term chooses
coordinates; further passes with a weak one learn those alone, so that rare but telling words keep
their full weight. The model is the list of non-zero weights: at most 2**BITS of them, which bounds
the broadcast. Documents are scored in Arrow batches.

Learning uses at most MAX_ROWS labelled documents (chosen by a hash of doc_id) whose crc32(doc_id as
text) mod 5 is not 0. Neither lang, source nor doc_id enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, map_text, ship_package, trim
from corpusloom.llm.textkernel import PUNCTUATION, Texts, mix
from corpusloom.llm.training import labelled, sample, sigmoid

BITS = 20
#: Labelled documents that the model is learned from, at most.
MAX_ROWS = 10_000
THRESHOLD = 0.5
HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 5 = 0"


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and the texts (as positions) they come from, repeats included."""
    t = Texts(texts, lower=True)
    starts, ends, owner = t.words(PUNCTUATION)
    w = t.hashes(starts, ends)
    parts, owners = [w], [owner]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x9FB21C651E98DF25)):
        same = owner[gap:] == owner[:-gap] if len(w) > gap else np.zeros(0, bool)
        pair = mix(w[:-gap] * np.uint64(salt) + w[gap:])[same] if len(w) > gap else w[:0]
        parts.append(pair)
        owners.append(owner[:-gap][same] if len(w) > gap else owner[:0])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def feature_sets(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    ids, owner = features(texts, bits)
    keys = np.unique((owner << bits) | ids)
    cuts = np.searchsorted(keys, np.arange(1, len(texts)) << bits)
    return np.split((keys & ((1 << bits) - 1)).astype(np.uint32), cuts)


@dataclass
class Model:
    weights: np.ndarray  # float32, by place
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        ids, owner = features(texts)
        hit = np.flatnonzero(self.weights[ids])
        keys = np.unique((owner[hit] << BITS) | ids[hit])
        total = np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], minlength=len(texts))
        return sigmoid(self.bias + total)


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float, l1: float, l2: float, epochs: int, beta: float = 1.0) -> Model:
    """FTRL-proximal over sparse binary rows; without rows, or with one class, all scores are the class's share."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size, np.float32), 35.0 if share else -35.0)
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    for _ in range(epochs):
        for ids, target in zip(rows, y, strict=True):
            zi, ni = z[ids], n[ids]
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
            w[np.abs(zi) <= l1] = 0
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = float(sigmoid(wb + w.sum())) - target
            g2 = g * g
            z[ids] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[ids] = ni + g2
            zb += g - (np.sqrt(nb + g2) - np.sqrt(nb)) / alpha * wb
            nb += g2
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0
    return Model(w.astype(np.float32), -zb / ((beta + np.sqrt(nb)) / alpha))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    ship_package(docs.sparkSession)
    rows, y, _ = sample(labelled(docs, labels, "toxic", max_rows, f"NOT ({HELD_OUT})"), feature_sets)
    chosen = ftrl(rows, y, 1 << BITS, alpha=1.0, l1=4.0, l2=0.1, epochs=1).weights != 0
    rows = [x[chosen[x]] for x in rows]
    trim()  # the driver lives on, and what follows needs none of the sample
    model = ftrl(rows, y, 1 << BITS, alpha=2.0, l1=0.1, l2=0.01, epochs=10)
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (the input row as a struct), score (0 to 1); null and empty texts get the bias alone."""
    places = np.flatnonzero(model.weights).astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast((places, model.weights[places], model.bias))  # at most 2**BITS pairs

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        where, values, bias = held.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[where] = values
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(Model(weights, bias).scores(as_bytes(batch.column(1))))], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return map_text(rows, run, rows.select("row", F.lit(0.0).alias("score")).schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, score, predicted (1 at THRESHOLD or above), for every row of docs; an empty table gives an empty result."""
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names.

    Texts are scored whole, however long; null and empty texts get the score of no feature. Repeated rows share their fate. A row with a null doc_id is scored like
    others but teaches nothing. Without labels nothing goes; an empty table gives an empty result.
    """
    return toxic_scores(docs, labels).where("predicted = 0").select("row.*")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row; see ``drop_toxic`` for nulls, repeats, long texts and empty tables. held_out is null where doc_id is; further columns are ignored."""
    found = toxic_scores(docs.select("doc_id", "text"), labels)
    return found.select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")
