"""Byte-level BPE by corpus-level merge replay, and its inverse.

A first pass counts the distinct pretokens of the corpus. Words are laid end to end as bytes, with an inverted
index from each mergeable pair of tokens to the word positions where it stands. Ranks are replayed in
order: all positions of the pairs that make a rank merge at once, and only the pairs with the touched
neighbours enter the index anew. Documents are then read off from the words' ids.

Each match of the pattern is encoded separately, so words can be dealt out and replayed apart with the
same result. The HELD_WORDS most frequent words of the corpus (at most, and none over HELD_BYTES, which
bounds the broadcast) are replayed once, in shards, and sent to all tasks; the rarer ones are replayed by the
same routine in the tasks that meet them. Words are told apart by their bytes, never by a hash
alone. A word in which a merge at several places would open a pair of lower
rank is encoded by itself, one merge at a time, as the order would matter there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, doc_columns, ship_package, slices, trim
from corpusloom.llm.pretokens import Pretokens, Seen, gather, keys_of
from corpusloom.llm.textkernel import distinct

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Text bytes that one replay covers, and pretokens that a worker remembers at most.
STRETCH_BYTES, CACHE_WORDS = 16_000_000, 1_000_000
#: Words of the corpus whose encodings are broadcast, and bytes of one, at most.
HELD_WORDS, HELD_BYTES = 1 << 17, 64


class Vocabulary:
    """Token bytes by rank, and the rank that each mergeable pair of tokens makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([x[0] for x in pairs], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs], np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where no token has their bytes."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_alone(self, word: bytes) -> list[int]:
        """One merge at a time: the least rank, the leftmost of equals."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or self.ranks.get(word[i : ends[j]]) != r:
                continue
            alive[j] = False
            ends[i] = ends[j]
            if ends[i] < n:
                before[ends[i]] = i
                if (s := self.ranks.get(word[i : ends[ends[i]]])) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := self.ranks.get(word[before[i] : ends[i]])) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [self.ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def replay(vocabulary: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words laid end to end (none empty), and how many each has."""
    n = len(data)
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    token = vocabulary.single[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = n  # none
    before[ends - lengths] = -1
    rank = np.full(n + 1, -1, np.int64)  # of the pair that begins here
    inner = np.flatnonzero(after < n)
    rank[inner] = vocabulary.merged(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}  # by pair of tokens
    making: dict[int, list[int]] = {}  # the index's pairs by the rank they make
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        positions = positions[rank[positions] >= 0]
        if not len(positions):
            return
        pair = (token[positions] << 32) | token[after[positions]]
        order = np.argsort(pair, kind="stable")
        positions, pair = positions[order], pair[order]
        cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(pair)]
        heads = bounds[:-1]
        for k, r, a, b in zip(pair[heads].tolist(), rank[positions[heads]].tolist(), heads, bounds[1:], strict=True):
            if k in index:
                index[k].append(positions[a:b])
                continue
            index[k] = [positions[a:b]]
            if r in making:
                making[r].append(k)
            else:
                making[r] = [k]
                heapq.heappush(heap, r)

    def _order_matters(p: np.ndarray) -> np.ndarray:
        """Words with several of the merges p where one of them alone would make a pair of lower rank."""
        words = of[p]
        several = np.zeros(len(p), bool)
        several[1:] = words[1:] == words[:-1]
        several[:-1] |= several[1:]
        p = p[several]
        made = rank[p]
        right, left = after[after[p]], before[p]
        lower = np.zeros(len(p), bool)
        for a, b, there in ((made, token[np.minimum(right, n - 1)], right < n), (token[left], made, left >= 0), (made, made, right < n)):
            r = vocabulary.merged(a, b)
            lower |= there & (r >= 0) & (r < made)
        return np.unique(of[p[lower]])

    enter(inner)
    alone: set[int] = set()
    while heap:
        r = heapq.heappop(heap)
        lists = [x for k in making.pop(r) for x in index.pop(k)]
        p = lists[0] if len(lists) == 1 else np.concatenate(lists)
        p = p[rank[p] == r]
        if len(p) > 1:
            p = np.unique(p)
            touching = np.zeros(len(p), bool)
            touching[1:] = after[p[:-1]] == p[1:]
            if touching.any():  # of pairs that share a token the leftmost merges, then the next but one
                k = np.arange(len(p))
                p = p[(k - np.maximum.accumulate(np.where(touching, 0, k))) % 2 == 0]
        if len(p) > 1 and (odd := _order_matters(p)).size:
            alone.update(odd.tolist())
            p = p[~np.isin(of[p], odd)]
            for w in odd.tolist():
                rank[ends[w] - lengths[w] : ends[w]] = -1
        if not len(p):
            continue
        gone = after[p]
        following = after[gone]
        token[p] = r
        after[p] = following
        known = following < n
        before[following[known]] = p[known]
        rank[gone] = -1
        left = before[p]
        left = left[left >= 0]
        rank[left] = vocabulary.merged(token[left], token[p[before[p] >= 0]])
        rank[p] = -1
        rank[p[known]] = vocabulary.merged(token[p[known]], token[following[known]])
        touched = np.unique(np.concatenate([left, p]))
        enter(touched)
    stays = np.zeros(n, bool)
    stays[ends - lengths] = True
    live = ends - lengths
    while len(live):  # from each live position to the next
        live = after[live]
        live = live[live < n]
        stays[live] = True
    counts = np.add.reduceat(stays.astype(np.int64), ends - lengths) if len(lengths) else lengths
    ids = token[stays]
    if alone:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in alone:
            parts[w] = np.array(vocabulary.encode_alone(data[ends[w] - lengths[w] : ends[w]].tobytes()), np.int64)
            counts[w] = len(parts[w])
        ids = np.concatenate(parts)
    return ids, counts


Held = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Encoder:
    """Encodes stretches of texts; knows the tokens and the held words, and remembers further words between stretches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held: tuple[str, Held] | None = None
        self.forget()

    def hold(self, held: tuple[str, Held]) -> None:
        """A name, and words that are encoded already: bytes end to end, lengths, ids end to end, ids of each."""
        if self.held is None or self.held[0] != held[0]:
            self.held = held
            self.forget()

    def forget(self) -> None:
        v = self.vocabulary
        self.seen, self.longer = Seen(), {}
        known = np.flatnonzero(v.lengths)
        self.seen.add(*keys_of([v.tokens[i] for i in known], self.longer))
        self.starts, self.counts, self.ids = np.arange(len(known)), np.ones(len(known), np.int64), known.astype(np.uint32)
        if self.held is not None:
            data, lengths, ids, counts = self.held[1]
            ends = np.cumsum(lengths)
            raw = data.tobytes()
            lo, hi = keys_of([raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], self.longer)
            new = self.seen.find(lo, hi) < 0
            begin = np.cumsum(counts) - counts
            self._append(lo[new], hi[new], ids[gather(begin[new], counts[new])], counts[new])
        self.least = len(self.counts)

    def _append(self, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.seen.add(lo, hi)
        self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def __call__(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part, the ids of its texts one after another and how many each text has."""
        if len(self.counts) - self.least > CACHE_WORDS:
            self.forget()
        found, fresh = [], []
        for texts in parts:
            t = Pretokens(texts)
            lo, hi = t.keys(self.longer)
            first, inverse = distinct(lo, hi)
            lo, hi = lo[first], hi[first]
            found.append((lo, hi, inverse.astype(np.int32), t.owner.astype(np.int32), t.n))
            new = np.flatnonzero(self.seen.find(lo, hi) < 0)
            a, n = t.starts[first[new]], t.ends[first[new]] - t.starts[first[new]]
            fresh.append((lo[new], hi[new], t.data[gather(a, n)], n))
        self._learn(*(np.concatenate(x) for x in zip(*fresh, strict=True)))
        for lo, hi, inverse, owner, n in found:
            rows = self.seen.find(lo, hi)[inverse]
            counts = self.counts[rows]
            yield self.ids[gather(self.starts[rows], counts)], np.bincount(owner, counts, minlength=n).astype(np.int64)

    def _learn(self, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
        first, _ = distinct(lo, hi)
        starts = (np.cumsum(lengths) - lengths)[first]
        ids, counts = replay(self.vocabulary, data[gather(starts, lengths[first])], lengths[first])
        self._append(lo[first], hi[first], ids, counts)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def decode_ids(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of the ids, one after another."""
    return v.flat[gather(v.offsets[ids], v.lengths[ids])]


def stretches(batches: Iterator[pa.RecordBatch], most: int = STRETCH_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches (second column: text), as many at a time as hold about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            size += part.column(1).nbytes
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held
    del held
    trim()


def corpus_words(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """word (bytes) of the most frequent pretokens of all texts: at most HELD_WORDS, none over HELD_BYTES.

    Each stretch counts its words and sends on those that it has more than once; counts are combined on the map side. The cut
    lies at a count, by quarters of powers of two. Which words are held does not change any result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in stretches(batches):
            longer: dict[bytes, int] = {}
            found = []
            for part in parts:
                t = Pretokens([x or "" for x in part.column(1).to_pylist()])
                short = t.ends - t.starts <= HELD_BYTES
                t.starts, t.ends = t.starts[short], t.ends[short]
                lo, hi = t.keys(longer)
                first, inverse = distinct(lo, hi)
                n = t.ends[first] - t.starts[first]
                found.append((lo[first], hi[first], t.data[gather(t.starts[first], n)], n, np.bincount(inverse, minlength=len(first))))
            lo, hi, data, n, times = (np.concatenate(x) for x in zip(*found, strict=True))
            first, inverse = distinct(lo, hi)
            total = np.bincount(inverse, times, len(first)).astype(np.int64)
            first, total = first[total > 1], total[total > 1]
            begin = (np.cumsum(n) - n)[first]
            yield pa.RecordBatch.from_arrays([binaries(data[gather(begin, n[first])], n[first]), pa.array(total)], ["word", "n"])

    counts = scratch.store(docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 4)
    left, least = HELD_WORDS, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 256 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return counts.where(level >= least if least is not None else F.lit(False)).select("word")


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings end to end as an Arrow array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def held_words(docs: DataFrame, path: str):
    """The broadcast encodings of the corpus's most frequent words."""
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids, counts = replay(vocabulary(path), np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(ids.astype(np.uint32).view(np.uint8), counts * 4)], ["word", "ids"])

    got = corpus_words(scratch, docs).mapInArrow(run, "word binary, ids binary").toArrow()  # at most HELD_WORDS rows of bounded size
    scratch.clear()
    words, ids = (got[c].to_pylist() for c in ("word", "ids"))
    sizes = lambda xs, unit: np.fromiter((len(x) // unit for x in xs), np.int64, len(xs))
    held: Held = (np.frombuffer(b"".join(words), np.uint8), sizes(words, 1), np.frombuffer(b"".join(ids), np.uint32), sizes(ids, 4))
    return docs.sparkSession.sparkContext.broadcast((scratch.base, held))


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, held, most: int = STRETCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices (first column: doc_id, second: text) with the ids of their texts; a null text is empty."""
    encoder = _encoder(path)
    encoder.hold(held.value)
    for parts in stretches(batches, most):
        texts = [[x or "" for x in p.column(1).to_pylist()] for p in parts]
        yield from ((p, *out) for p, out in zip(parts, encoder(texts), strict=True))


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row; null and empty texts have no ids, repeated rows come repeated."""
    path = path or public_tokenizers.path(VOCABULARY)
    ship_package(docs.sparkSession)
    docs = doc_columns(docs)
    held = held_words(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, counts in encoded_batches(batches, path, held):
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data (bytes) of rows with doc_id, ids; null and empty ids give no bytes, repeated rows come repeated.

    Ids outside the vocabulary raise. An empty table gives an empty result; further columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [decode_ids(v, np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op4_bpe_roundtrip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: both ways in one pass, as ids need not leave the worker.

    Null and empty texts have no ids, repeated rows come repeated, an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ship_package(docs.sparkSession)
    docs = doc_columns(docs)
    held = held_words(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part, ids, counts in encoded_batches(batches, path, held):
            ids_of = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
            bytes_of = np.split(decode_ids(v, ids), np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), v.lengths[ids], minlength=len(counts)).astype(np.int64))[:-1])
            digests = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in xs]) for xs in (ids_of, bytes_of)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
