"""Phrases whose words stand together, by position bitmaps.

The texts of a language, words end to end with a gap wherever a piece ends, make shards. A shard has a bitmap of
positions for each of its words, compressed to the bytes of eight positions that hold any. Shifted by one
position and joined with another word's bitmap by AND, a bitmap becomes that of the longer phrase's ends; its bits are the
phrase's occurrences. Extension goes depth-first: phrases of some first words are followed to their full length before the next.
Popcounts add up over the shards.

Words, and then pairs, that are too rare in the whole corpus begin no phrase. Pairs, and then longer phrases, are first added up by cells of a hash, which is
enough to tell most of the rare ones. What is frequent goes to the
shards as a filter of a fixed number of bits: what it lets through by chance is counted like the rest and dropped by its exact count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, as_bytes, trim
from corpusloom.llm.pretokens import gather
from corpusloom.llm.textkernel import LOWER, distinct, exact_keys, mix

LEAST, LONGEST, FIRST = 30, 4, 2000
#: A longer phrase with at least this share, in per cent, of a phrase's occurrences stands for it.
SHARE = 80
#: Positions from which a shard is closed, pairs of blocks joined at a time, bits of a filter.
POSITIONS, JOINED, BITS = 1 << 17, 1 << 18, 1 << 27
_BUCKET = 1 << 15  # bits of a part of Spark's bitmaps

_GAP, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True


def sorted_by(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of numbers from 0 on, the first counting most."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    if np.prod([float(x) for x in sizes]) >= 2**62:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, size in zip(columns[1:], sizes[1:], strict=True):
        key = key * size + c
    return np.argsort(key)


class Bitmaps:
    """Bitmaps by name (a number): the blocks that hold any position and their bits, names together and blocks in order."""

    def __init__(self, name: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.name, self.block, self.bits = name, block, bits

    @classmethod
    def of(cls, name: np.ndarray, position: np.ndarray) -> Bitmaps:
        """name, position: sorted by name, then position."""
        block = position >> 3
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (block[1:] != block[:-1]))) if len(name) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(np.uint8(1) << (position & 7).astype(np.uint8), first) if len(name) else np.zeros(0, np.uint8)
        return cls(name[first], block[first], bits)

    def take(self, kept: np.ndarray) -> Bitmaps:
        return Bitmaps(self.name[kept], self.block[kept], self.bits[kept])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Names in order of their bitmaps, and positions of each."""
        if not len(self.name):
            return self.name, self.block
        first = np.flatnonzero(np.append(True, self.name[1:] != self.name[:-1]))
        return self.name[first], np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), first)

    def shifted(self) -> Bitmaps:
        """Each position moved on by one; what leaves a block by its last bit enters the next block, which may come twice then."""
        carried = self.bits >> np.uint8(7)
        over = np.flatnonzero(carried)
        name, block, bits = (np.concatenate(x) for x in ((self.name, self.name[over]), (self.block, self.block[over] + 1), (self.bits << np.uint8(1), carried[over])))
        order = sorted_by(name, block) if len(over) else slice(None)
        return Bitmaps(name[order], block[order], bits[order]).take(bits[order] != 0)


def joined(left: Bitmaps, right: Bitmaps, key_left: np.ndarray, key_right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of left, rows of right and the AND of their bits, where keys (block and what else must agree) are equal and bits are left.

    At most JOINED pairs are tried at a time; rows of left come in order.
    """
    order = np.argsort(key_right, kind="stable")
    ordered = key_right[order]
    low, high = np.searchsorted(ordered, key_left), np.searchsorted(ordered, key_left, side="right")
    sizes = high - low
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED, side="right")))
        a = np.repeat(np.arange(at, stop), sizes[at:stop])
        b = order[gather(low[at:stop], sizes[at:stop])]
        bits = left.bits[a] & right.bits[b]
        hit = np.flatnonzero(bits)
        yield a[hit], b[hit], bits[hit]
        at = stop


def together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
    """Bitmaps of (first, last, block, bits) rows, by pairs in order, and the pairs' first and last."""
    first, last, block, bits = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    order = sorted_by(first, last, block)
    first, last, block, bits = (x[order] for x in (first, last, block, bits))
    new = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])) if len(first) else np.zeros(0, bool)
    return Bitmaps(np.cumsum(new) - 1, block, bits.astype(np.uint8)), first[new], last[new]


def extended(left: Bitmaps, right: Bitmaps, last: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
    """Bitmaps of left's phrases followed by one of right's. last: the last word of left's by name, first: the first word of right's; these must be the same where given, and overlap."""
    if last is None:
        moved = left.shifted()
        keys = moved.block, right.block
    else:
        moved = left.shifted()
        keys = (moved.block << 32) | last[moved.name], (right.block << 32) | first[right.name]
    return together([(moved.name[a], right.name[b], moved.block[a], bits) for a, b, bits in joined(moved, right, *keys)])


class Shard:
    """A shard's words and their bitmaps."""

    def __init__(self, words: pa.Array, hashes: np.ndarray, bitmaps: Bitmaps):
        self.words, self.hashes, self.bitmaps = words, hashes, bitmaps

    def phrases(self, names: list[np.ndarray]) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(x)) for x in names], " ")

    def pairs(self, frequent: Filter) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
        kept = frequent.has(self.hashes)
        single = self.bitmaps.take(kept[self.bitmaps.name])
        return extended(single, single)

    def pair_cells(self, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the pairs of frequent words, and counts."""
        bitmaps, first, last = self.pairs(frequent)
        return cell(followed(mixed(self.hashes[first]), self.hashes[last])), bitmaps.counts()[1]

    def grown(self, frequent: Filter, pairs: Filter, longest: int, longer: Filter | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """The words of phrases of two words and more, their hashes, their counts; those that begin with some pairs to the full length before the next.

        ``pairs`` and ``longer`` hold the cells of those that may be frequent: others are left out, and do not go on.
        """
        bitmaps, first, last = self.pairs(frequent)
        hashes = followed(mixed(self.hashes[first]), self.hashes[last])
        kept = pairs.has(cell(hashes))
        bitmaps = bitmaps.take(kept[bitmaps.name])
        roots = np.flatnonzero(kept)
        starts = np.searchsorted(bitmaps.name, np.append(roots, len(first)))
        step = max(1, len(roots) * JOINED // max(1, 4 * len(bitmaps.name)))
        for i in range(0, len(roots), step):
            own = bitmaps.take(np.arange(starts[i], starts[min(i + step, len(roots))]))
            names, known, h = [first, last], roots[i : i + step], hashes
            for n in range(2, longest + 1):
                yield [x[known] for x in names], h[known], own.counts()[1]
                if n == longest:
                    break
                own, before, pair = extended(own, bitmaps, names[-1], first)
                names = [*(x[before] for x in names), last[pair]]
                h, known = followed(h[before], self.hashes[last[pair]]), np.arange(len(before))
                if longer is not None:
                    may = longer.has(cell(h))
                    own, known = own.take(may[own.name]), np.flatnonzero(may)
                if not len(known):
                    break


def mixed(h: np.ndarray) -> np.ndarray:
    return mix(h.view(np.uint64))


def followed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(phrase + word.view(np.uint64))


def cell(phrase: np.ndarray) -> np.ndarray:
    """A number of 32 bits."""
    return (phrase & np.uint64(0xFFFFFFFF)).view(np.int64)


class Filter:
    """Hashes that may be in a set: a bit each of 2**n, as bytes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & (len(self.bits) * 8 - 1)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, hashes: DataFrame, most: int = BITS) -> Filter:
        """hashes: h, a long. Sixteen bits for each hash, at most ``most`` in all; the driver gets no more than that."""
        size = _BUCKET
        n = hashes.count()
        while size < min(most, 16 * n):
            size *= 2
        place = F.col("h").bitwiseAND(F.lit(size - 1))
        parts = hashes.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(_BUCKET - 1)).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
        bits = np.zeros(size // 8, np.uint8)
        for r in parts.toLocalIterator():  # at most size / _BUCKET rows of 4 KB
            bits[r["part"] * (_BUCKET // 8) :][: _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)


def shard_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, Bitmaps]:
    """Words of texts, lower case, their numbers of occurrences, and their bitmaps."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    gap = _GAP[data]
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = gap | _SPACE[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return [], none, Bitmaps(none, none, none.astype(np.uint8))
    ended = np.cumsum(gap)[starts]  # gaps before each word
    position = np.arange(len(starts)) + np.cumsum(np.append(0, ended[1:] != ended[:-1]))
    first, name = distinct(*exact_keys(data, starts, ends, {}))
    order = np.argsort(name, kind="stable")
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, np.bincount(name), Bitmaps.of(name[order], position[order])


_SHARD = "lang string, words array<string>, counts array<long>, blocks array<int>, places binary, bits binary"
#: Bytes of text that make a shard of about POSITIONS words, and that a task holds back at most before it closes the largest.
_TEXT, _HELD = POSITIONS * 6, POSITIONS * 384
#: Bits of a part of the cells, at most 24, and cells that a task holds.
_CELL_BITS, _MET = 20, 1 << 20
_ROW_GROUP = 8 << 20  # bytes of a row group of stored shards, which a reader holds whole


def shards(docs: DataFrame) -> DataFrame:
    """A row for each shard: lang, words, counts, blocks (how many each word has), places (int32) and bits (a byte) of the blocks."""

    def made(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, counts, bitmaps = shard_of(texts)
        columns = [pa.array([lang]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([np.bincount(bitmaps.name, minlength=len(words))], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([bitmaps.block.astype("<i4").tobytes()]), pa.array([bitmaps.bits.tobytes()])], [x.split()[0] for x in _SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                texts.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                while sizes.get(lang, 0) >= _TEXT or sum(sizes.values()) >= _HELD:
                    most = max(sizes, key=sizes.__getitem__)
                    sizes.pop(most)
                    yield made(most, texts.pop(most))
        for lang, own in texts.items():
            yield made(lang, own)
        trim()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SHARD)


def _read(batch: pa.RecordBatch, i: int) -> Shard:
    words, hashes, blocks = (batch.column(c)[i].values for c in (1, 2, 3))
    places, bits = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((4, "<i4"), (5, "u1")))
    return Shard(words, hashes.to_numpy(), Bitmaps(np.repeat(np.arange(len(words)), blocks.to_numpy()), places.astype(np.int64), bits))


def _counted(stored: DataFrame, make) -> DataFrame:
    """lang, phrase, n, f summed over shards. make: from a shard, (phrases, counts, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                for phrases, counts, n in make(_read(batch, i)):
                    if len(counts):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), phrases, pa.array(np.full(len(counts), n, np.int32)), pa.array(counts)], ["lang", "phrase", "n", "f"])
        trim()

    return _hashed(stored).mapInArrow(run, "lang string, phrase string, n int, f long").groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f"))


def _packed(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the cells: part, and the cells' distances and counts (at most 255 each), byte by byte of their numbers."""
    cells, at = np.unique(cells, return_inverse=True)
    counts = np.minimum(np.bincount(at, counts, len(cells)), 255).astype(np.uint8)
    part = cells >> _CELL_BITS
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(cells) else np.zeros(0, np.int64)
    apart = np.diff(cells, prepend=0)
    apart[first] = cells[first] & ((1 << _CELL_BITS) - 1)
    planes = apart.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    rows = [np.append(planes[i:j].T.ravel(), counts[i:j]).tobytes() for i, j in zip(first.tolist(), np.append(first[1:], len(cells))[: len(first)].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(rows, pa.binary())], ["part", "cells"])


def frequent_cells(stored: DataFrame, least: int, cells) -> DataFrame:
    """h: cells of phrases (``cells`` gives a shard's, with counts) whose occurrences in the corpus add up to ``least`` or more, together with those of other phrases of the cell.

    A task sends about two bytes for a cell it has met. Cells are dealt out in parts of 2**_CELL_BITS, each added up in an array of that size whatever the input.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for found in cells(_read(batch, i)):
                    held.append(found)
                    if sum(len(x) for x, _ in held) >= _MET:
                        yield _packed(*map(np.concatenate, zip(*held, strict=True)))
                        held = []
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)))
        trim()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, np.zeros(1 << _CELL_BITS, np.int32)

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((part << _CELL_BITS) + np.flatnonzero(sums >= least))], ["h"])

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != part:
                    if part is not None:
                        yield found()
                    part = at
                    sums[:] = 0
                planes = np.frombuffer(raw, np.uint8).reshape(4, -1).astype(np.int64)
                cells = np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16)
                sums[cells] = np.minimum(sums[cells] + planes[3], 1 << 30)
        if part is not None:
            yield found()
        trim()

    packed = _hashed(stored).mapInArrow(met, "part int, cells binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(added, "h long")


def _hashed(stored: DataFrame) -> DataFrame:
    return stored.select("lang", "words", F.transform("words", lambda w: F.xxhash64("lang", w)).alias("hashes"), "blocks", "places", "bits")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, scratch: Scratch | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, n (words), f of all phrases of up to ``longest`` words that occur ``least`` times or more, and lang, total: all word occurrences."""
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    stored = scratch.store(shards(docs), "shards", **{"parquet.block.size": _ROW_GROUP})
    each = stored.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("phrase")).agg(F.sum("x.counts").alias("f"))
    words = scratch.store(each, "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("total"))
    single = words.where(F.col("f") >= least)
    frequent = spark.sparkContext.broadcast(Filter.of(single.select(F.xxhash64("lang", "phrase").alias("h")), bits))

    filtered = lambda cells, name: spark.sparkContext.broadcast(Filter.of(scratch.store(frequent_cells(stored, least, cells), name), bits))
    pairs = filtered(lambda shard: [shard.pair_cells(frequent.value)], "pairs")

    def longer_cells(shard: Shard):
        yield from ((cell(h), counts) for names, h, counts in shard.grown(frequent.value, pairs.value, longest) if len(names) > 2)

    longer = filtered(longer_cells, "longer")

    def phrases(shard: Shard):
        yield from ((shard.phrases(names), counts, len(names)) for names, _, counts in shard.grown(frequent.value, pairs.value, longest, longer.value))

    several = scratch.store(_counted(stored, phrases).where(F.col("f") >= least), "several")
    return single.select("lang", "phrase", F.lit(1).alias("n"), "f").unionByName(several), totals


def _words(first, count):
    """Some of a phrase's words as a phrase."""
    return F.array_join(F.slice("words", first, count), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    docs: text, lang. Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and these into words at spaces and tabs. A phrase's a occurrences, overlaps included,
    are within pieces; its score is floor(2000000 a / (l + r)) for the cut into phrases of l and r occurrences that makes it least, of equals the one after fewest words. Phrases of which
    a longer one has ``share`` per cent of the occurrences or more are left out. Ranks go by score, then a, both descending, then the phrase's bytes, so no two rows tie.

    A null text is empty, a null lang 'und'. Repeated rows count as often as they come, doc_id does not matter. A text longer than a shard is a shard by itself. An empty table and one without
    frequent phrases give an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    phrases, totals = phrase_counts(docs, least, longest, scratch, bits)
    several = phrases.where("n > 1").withColumn("words", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: _words(i, m))))
    within = several.where("n > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), "words", "n")
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)")
    least_cut = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scratch.store(least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")

    # ranks without a sort of a language in one task: parts of a range each know how many rows come before
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranges = scratch.store(scored.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("lang", "part").agg(F.count("*").alias("size"))
    w = Window.partitionBy("lang").orderBy("part")
    before = sizes.withColumn("before", F.sum("size").over(w) - F.col("size")).where(F.col("before") < first).drop("size")
    placed = ranges.join(before, ["lang", "part"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)) + F.col("before"))
    return placed.where(F.col("rank") <= first).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(docs: DataFrame) -> DataFrame:
    """``collocations`` of whole documents with the production parameters; see there for nulls, ties and repeats."""
    return collocations(docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAMS = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase, {n} AS n FROM p" for n in range(1, LONGEST + 1))
OP11_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM t),
f AS MATERIALIZED (SELECT lang, phrase, n, count(*) AS f FROM ({_GRAMS}) GROUP BY 1, 2, 3 HAVING n = 1 OR count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n > 1),
lo AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, n), lambda m: list_transform(range(1, n - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM c WHERE n > 2) GROUP BY 1, 2),
k AS (SELECT c.lang, c.phrase, c.f AS a, c.w, unnest(range(1, c.n)) AS k FROM c LEFT JOIN lo USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * c.f),
s AS (SELECT k.lang, k.phrase, a, k, h.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(h.f AS HUGEINT) + r.f) AS BIGINT) AS score FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER v AS rank, phrase, a, l, r, n.n, score FROM b JOIN n USING (lang) WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER v <= {FIRST}"""
