"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed places: raw, counted over all documents, and target, counted
over labelled good ones. A document's log weight is the sum over its n-grams of log(target / raw);
adding Gumbel noise drawn from a hash of its doc_id and keeping the largest k samples k documents
without replacement in proportion to their weights. N-grams are tokens (runs of letters and digits, or of
punctuation), pairs of tokens, and triples of token shapes (case, digits, whether the token repeats
the one before), so that new words still tell how a text is written.

The target model is fitted on at most MAX_ROWS labelled documents, chosen by a hash of doc_id;
counts of the raw model, log weights and the choice cover all documents. The k-th largest key is found by counting
16 bits at a time (at most 65,536 counts reach the driver), so nothing is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, as_bytes, doc_columns, map_text, slices
from corpusloom.llm.textkernel import LOWER, SPACE, Texts, mix, running, spans
from corpusloom.llm.training import labelled

BITS, MAX_ROWS, SEED = 15, 20_000, 7
#: Added to each place's count, as a share of the mean count.
SMOOTHING = 0.1
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_KIND = np.where(SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
_UPPER, _DIGIT = (np.array([b < 128 and f(chr(b)) for b in range(256)]) for f in (str.isupper, str.isdigit))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams and the texts (as positions) they come from."""
    t = Texts(texts)
    kind = np.zeros(len(t.data) + 2, np.uint8)
    kind[1:-1] = _KIND[t.data]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    starts = edge[kind[1:][edge] > 0]
    ends = edge[kind[:-1][edge] > 0]
    owner = np.searchsorted(t.starts, starts, side="right") - 1
    w = spans(running(LOWER[t.data].astype(np.uint64) + np.uint64(1)), starts, ends)
    within = lambda flags: np.diff(np.stack([(c := np.concatenate([[0], np.cumsum(flags)]))[starts], c[ends]]), axis=0)[0]
    upper, digits, size = within(_UPPER[t.data]), within(_DIGIT[t.data]), ends - starts
    shape = 1 + (upper > 0) + (upper > 1).astype(np.int64) + 4 * (digits > 0) + 8 * (size > 6)
    repeat = np.zeros(len(w), np.int64)
    repeat[1:] = (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])
    is_word = _KIND[t.data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    shape = np.where(is_word, shape.astype(np.uint64), w) + repeat.astype(np.uint64) * np.uint64(1 << 40)
    ids, owners = [mix(w)], [owner]
    for values, n, salt in ((w, 2, 0x632BE59BD9B4E019), (shape, 3, 0x9FB21C651E98DF25)):
        at = np.arange(max(0, len(w) - n + 1))
        at = at[owner[at] == owner[at + n - 1]] if len(at) else at
        ids.append(mix(spans(running(values), at, at + n) ^ np.uint64(salt)))
        owners.append(owner[at])
    return (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def counts(rows: DataFrame) -> np.ndarray:
    """N-grams of all rows' texts (second column) by place; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(features(as_bytes(part.column(1)))[0], minlength=1 << BITS)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    got = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most 2**BITS rows
    out = np.zeros(1 << BITS, np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) by place, both smoothed; zero everywhere without a target."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    share = lambda x: (x + SMOOTHING * x.mean()) / (x.sum() * (1 + SMOOTHING))
    return np.log(share(target.astype(float)) / share(raw.astype(float)))


def gumbel(doc_id: np.ndarray, seed: int = SEED) -> np.ndarray:
    u = (mix(mix(doc_id.astype(np.int64).view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


def sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles, none of which are NaN."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column ``key`` (stored), by four rounds of at most 65,536 counts; None if there are fewer."""
    low, left = 0, k
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    for shift in (48, 32, 16, 0):
        inside = keys if shift == 48 else keys.where(F.shiftrightunsigned(flipped, shift + 16) == low)
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(0xFFFF))
        rows = sorted(inside.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in rows:
            if n >= left:
                low = low << 16 | d
                break
            left -= n
        else:
            return None
    return (low ^ (1 << 63)) - (1 << 64) if (low ^ (1 << 63)) >> 63 else low ^ (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_ngrams, log_weight, selected, for every row of docs.

    ``keep_share`` of the rows are selected, by default the share of good documents among the labelled ones used.
    Rows that tie with the last one selected are selected too (repeated rows share doc_id and so
    noise). Null and empty texts have log weight 0, a null doc_id hashes as -1. Without good
    labelled documents all weights are 0. Texts are counted whole, however long; further columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = doc_columns(docs)
    known = scratch.store(labelled(docs, labels, "quality", max_rows), "labelled")
    good = known.agg(F.coalesce(F.avg("y"), F.lit(1.0))).first()[0]
    ratio = log_ratio(counts(known.where("y = 1").select("doc_id", "text")), counts(docs))
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # 2**BITS numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, owner = features(as_bytes(batch.column(1)))
        weight = np.bincount(owner, held.value[ids], minlength=batch.num_rows)
        key = weight + gumbel(batch.column(0).fill_null(-1).to_numpy())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(owner, minlength=batch.num_rows)), pa.array(weight), pa.array(sortable(key))], ["doc_id", "n_ngrams", "log_weight", "key"])

    scored = scratch.store(map_text(docs, run, "doc_id long, n_ngrams long, log_weight double, key long"), "weights")
    share = good if keep_share is None else keep_share
    k = round(share * scored.count())
    least = kth_largest(scored, k) if k else None
    chosen = F.lit(False) if least is None else F.col("key") >= least
    return scored.select("doc_id", "n_ngrams", "log_weight", chosen.alias("selected"))


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_ngrams, log_weight, kept (selected) of every row."""
    return resample(docs, labels).withColumnRenamed("selected", "kept")
