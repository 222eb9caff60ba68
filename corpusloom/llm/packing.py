"""Best-fit packing of tokenised documents with large-item matching.

Documents become pieces of at most ``capacity`` tokens. Packing needs only how many pieces have each
length, at most ``capacity`` numbers, so it is solved exactly on that histogram, whole groups of
equal bins at a time: pieces above a third of the capacity take the largest such partner that
fits, at most two a bin; smaller ones, the longest first, go where they leave the least room. Each
piece then finds its place from its number among the pieces of its length, which comes from counts
by (length, share): a length has one share for each SHARE of its pieces, so a common length is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, doc_columns, slices, trim

CAPACITY = 2048
#: Pieces of one length that a task numbers, on average.
SHARE = 100_000
TOKENIZER = "byte_bpe_50k"
_END = 0


@dataclass(frozen=True)
class Bins:
    """``count`` bins that each hold ``items``: (length, how many), in order."""

    items: tuple[tuple[int, int], ...]
    count: int


def pack_histogram(sizes: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``sizes`` (pieces by length). Every piece is placed; no bin is over capacity."""
    left = {s: n for s, n in sizes.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("lengths must be from 1 to the capacity")
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    room: dict[int, list[Bins]] = defaultdict(list)  # by what is free
    gaps: list[int] = []  # sorted

    def put(bins: Bins) -> None:
        free = capacity - sum(s * n for s, n in bins.items)
        if not room[free]:
            at = int(np.searchsorted(gaps, free)) if gaps else 0
            gaps.insert(at, free)
        room[free].append(bins)

    for s in large:
        while left[s]:
            partner = next((p for p in large if p + s <= capacity and p <= s and left[p] > (p == s)), None)
            if partner is None:
                put(Bins(((s, 1),), left[s]))
                left[s] = 0
            elif partner == s:
                put(Bins(((s, 2),), left[s] // 2))
                left[s] %= 2
            else:
                n = min(left[s], left[partner])
                put(Bins(((s, 1), (partner, 1)), n))
                left[s] -= n
                left[partner] -= n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = int(np.searchsorted(gaps, s)) if gaps else 0
            if at == len(gaps):
                free, bins = capacity, Bins((), n)
            else:
                free = gaps[at]
                bins = room[free].pop()
                if not room[free]:
                    gaps.pop(at)
            each = min(free // s, n)
            full = min(bins.count, n // each)
            put(Bins((*bins.items, (s, each)), full))
            n -= full * each
            rest = bins.count - full
            if free < capacity or bins.items:
                if rest and n and n < each:  # the last of this length share one bin
                    put(Bins((*bins.items, (s, n)), 1))
                    rest, n = rest - 1, 0
                if rest:
                    put(Bins(bins.items, rest))
    return [b for free in sorted(room) for b in room[free]]


@dataclass
class Plan:
    """Places by length: where ``first`` <= number < the next row's, a piece is in bin base + (number - first) // each."""

    keys: np.ndarray  # length << 40 | first, sorted
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (length << 40) | number, side="right") - 1
        local = number - self.first[i]
        return self.base[i] + local // self.each[i], self.offset[i] + local % self.each[i] * length


def plan_of(bins: list[Bins]) -> Plan:
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for b in bins:
        offset = 0
        for s, n in b.items:
            rows.append(((s << 40) | used[s], used[s], n, base, offset))
            used[s] += n * b.count
            offset += s * n
        base += b.count
    rows.sort()
    return Plan(*(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5)), base)


@cache
def _encoding(name: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def token_ids(text: str, name: str = TOKENIZER) -> np.ndarray:
    """The ids that the tokenizers library gives for byte_bpe_50k.json without added special tokens (uint32).

    The same vocabulary through its ranks, which is several times faster; the special string inside
    a text is its id, as that library's default is. A test holds both against one another.
    """
    encoding = _encoding(name)
    if "<|endoftext|>" in text:
        return np.array(encoding.encode(text, allowed_special="all"), np.uint32)
    return np.array(encoding.encode_ordinary(text), np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the remainder."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((a, capacity) for a in range(head, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row per piece; null texts are empty, and each document ends with id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(token_ids(text or "", name), np.uint32(_END)).astype("<u4")
                    rows += [(doc, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cut(len(ids), capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return doc_columns(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, share: int = SHARE) -> DataFrame:
    """The pieces with sequence_id and offset.

    Sequences are numbered from 0 and filled without gaps. Null texts are empty documents of the end token alone.
    Repeated rows are packed as often as they come; a null doc_id stays null. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    stored = scratch.store(pieces(docs, capacity, name).withColumn("row", F.monotonically_increasing_id()), "pieces")  # numbers are as stored from here on
    sizes = np.zeros(capacity + 1, np.int64)
    for r in stored.groupBy("length").count().collect():  # at most ``capacity`` rows
        sizes[r["length"]] = r["count"]
    plan = plan_of(pack_histogram({s: int(n) for s, n in enumerate(sizes) if n}, capacity))
    shares = np.maximum(1, -(-sizes // share))
    first = np.cumsum(shares) - shares  # the shares of all lengths, one after another
    of = F.element_at(F.lit(shares.tolist()), F.col("length").cast("int") + 1)
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("row"), of).cast("long"))
    counts = np.zeros(int(shares.sum()), np.int64)
    for r in salted.groupBy("length", "salt").count().collect():  # at most capacity + pieces / share rows
        counts[first[r["length"]] + r["salt"]] = r["count"]
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[first], shares)  # among the pieces of the same length
    held = spark.sparkContext.broadcast((plan, first, before))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first, before = held.value
        for b in batches:
            length, salt, number = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "salt", "number"))
            sequence, offset = plan.place(length, before[first[length] + salt] + number)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*columns, "salt", "number").mapInArrow(run, out)


def op5_bestfit_packing(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece; see ``pack`` for nulls, repeats and empty tables."""
    return pack(docs)
