"""Cross-tokenizer alignment by elementary intervals.

Both tokenizers cut the same bytes. The union of their tokens' ends parts a text into elementary intervals, each of which lies in one
token of either (found by binary search), so each is one overlap; an interval that ends where both have an end closes a group, and
a group links each of its tokens of A with each of its tokens of B. A whole slice of texts is one such sequence,
as a text's end is an end of both.

Of a document's links the distinct id pairs are kept, with how often it has each. Documents that hold a pair are counted by one shuffle
of pairs, combined on the map side. The most frequent pairs (at most HELD, whatever the corpus) go back to the
documents as a broadcast, which settles nearly all links; the others are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, doc_columns, map_text, trim
from corpusloom.llm.packing import TOKENIZER, _encoding
from corpusloom.llm.pretokens import gather

PIECES = "piece_bpe_32k"
#: Pairs whose counts are broadcast (16 bytes each), links of a group from which its distinct ids are paired first; stretches of text that a worker remembers.
HELD, LARGE = 1 << 21, 1 << 12
REMEMBERED = 400_000


#: Stretches of text that both tokenizers encode by themselves: white space, then all up to the next. Texts with other white space than this are encoded whole.
_STRETCH, _OTHER_SPACE = re.compile(r"[\t\n\x0b\x0c ]*[^\t\n\x0b\x0c ]+|[\t\n\x0b\x0c ]+"), re.compile("[\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Aligner:
    """The two tokenizers and their tokens' bytes. A is a byte-level BPE by its ranks, which give the ids of its JSON file; B is a sentencepiece model.

    A's pattern parts a text before white space, and no piece of B goes on with white space after something else, so stretches are encoded
    once and remembered, up to REMEMBERED of them; ids of a text are those of its stretches, end to end. Tests hold them against both libraries.
    """

    def __init__(self, a: str = TOKENIZER, b: str = PIECES):
        import sentencepiece

        self.a = _encoding(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.parts = not any("▁" in p.lstrip("▁") or len(p) > 1 and re.search("[\t\n\x0b\x0c]", p) for p in pieces) and len(self.b.encode("\n")) == 2
        most = max(len(self.a_bytes), n)
        # decimal digits, aligned to the right, zero where there is none; a last column for what follows
        width = len(str(most - 1))
        tens, number = 10 ** np.arange(width - 1, -1, -1), np.arange(most)[:, None]
        digits = (number // tens % 10 + ord("0")).astype(np.uint8)
        digits[(number < tens) & (tens > 1)] = 0
        self.digits = np.hstack([digits, np.zeros((most, 1), np.uint8)])
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64)] * 2  # of A and of B, of all stretches
        self.offsets = [np.zeros(1, np.int64)] * 2
        self.good = np.zeros(0, bool)

    def _alone(self, x: str) -> tuple[list[int], list[int]]:
        return self.a.encode_ordinary(x), self.b.encode("\n" + x)[2:] if self.parts else self.b.encode(x[1:])

    def _learn(self, new: list[str]) -> None:
        """Encode stretches that end without white space in one piece, and the others, or all if that goes wrong, one by one."""
        raw = [x.encode() for x in new]
        ends = np.cumsum([len(x) for x in raw])
        good = np.ones(len(new), bool)
        whole = "".join(new)
        ids = [np.array(x, np.int64) for x in self._alone(whole)]
        places = [np.cumsum(size[x]) for size, x in zip((self.a_size, self.b_size), ids, strict=True)]
        spelt = all(b"".join([t[i] for i in x.tolist()]) == b"".join(raw) for t, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
        counts = [np.diff(np.searchsorted(p, ends) + 1, prepend=0) for p in places] if spelt else []
        if not spelt:
            each = [self._alone(x) for x in new]
            good = np.array([all(b"".join([t[i] for i in own]) == x for t, own in zip((self.a_bytes, self.b_bytes), e, strict=True)) for x, e in zip(raw, each, strict=True)])
            ids = [np.array([i for e in each for i in e[side]], np.int64) for side in (0, 1)]
            counts = [np.array([len(e[side]) for e in each], np.int64) for side in (0, 1)]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.good = np.append(self.good, good)
        self.ids = [np.append(*x) for x in zip(self.ids, ids, strict=True)]
        self.offsets = [np.append(o, o[-1] + np.cumsum(c)) for o, c in zip(self.offsets, counts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for a space and each text, ids of B for each text, and their numbers by text.

        None where a text is empty or its tokens' bytes are not those of a space and the text.
        """
        if len(self.places) > REMEMBERED:
            self.forget()
        apart = [[] if not x else [" " + x] if not self.parts or _OTHER_SPACE.search(x) else _STRETCH.findall(" " + x) for x in texts]
        each = [s for x in apart for s in x]
        new = set(each).difference(self.places)
        odd = {x for x in new if x[-1] in "\t\n\x0b\x0c " or not self.parts or _OTHER_SPACE.search(x)}
        for part in ([x] for x in sorted(odd)):
            self._learn(part)
        if new := sorted(new - odd):
            self._learn(new)
        at = np.fromiter(map(self.places.__getitem__, each), np.int64, len(each))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in apart])
        bad = np.zeros(len(texts), bool)
        bad[owner[~self.good[at]]] = True
        at, owner = at[~bad[owner]], owner[~bad[owner]]
        out = []
        for ids, offsets in zip(self.ids, self.offsets, strict=True):
            sizes = offsets[at + 1] - offsets[at]
            out += [ids[gather(offsets[at], sizes)], np.bincount(owner, sizes, minlength=len(texts)).astype(np.int64)]
        return out[0], out[2], out[1], out[3]

    def digests(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, groups: np.ndarray) -> list[str]:
        """groups_sha256 of texts, from their ids, the groups' counts of tokens, and the texts' counts of groups."""
        last_a, last_b = np.cumsum(na), np.cumsum(nb)
        ends = np.cumsum(groups)
        out = np.zeros((len(a) + len(b), self.digits.shape[1]), np.uint8)
        before_b, after_a = np.repeat(last_b - nb, na), np.repeat(last_a, nb)  # a group's tokens of A come first, then those of B
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + after_a
        for ids, place in ((a, place_a), (b, place_b)):
            rows = self.digits[ids]
            rows[:, -1] = ord(",")
            out[place] = rows
        out[place_a[last_a - 1], -1] = ord("|")
        out[place_b[last_b - 1], -1] = ord(";")
        tokens = np.append(0, (last_a + last_b)[ends[groups > 0] - 1]) if len(na) else np.zeros(1, np.int64)
        out[tokens[1:] - 1, -1] = 0
        held = out != 0
        sizes = np.append(0, np.cumsum(held.sum(axis=1)))[tokens]
        raw = out[held].tobytes()
        found = iter([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)])
        return [next(found) if n else "" for n in groups.tolist()]


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group, from the sorted places where the tokens end; the last end is one of both."""
    cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs are merged
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]  # an elementary interval ends at each
    owner_a, owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    closes = (ends_a[owner_a] == cuts) & (ends_b[owner_b] == cuts)
    return np.diff(owner_a[closes] + 1, prepend=0), np.diff(owner_b[closes] + 1, prepend=0)


def linked_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the distinct id pairs that each text links, sorted. A pair is a * width + b; owner: the groups' texts."""
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    links = na * nb
    small = links <= LARGE
    each = np.repeat(nb[small], na[small])  # links of each token of A, in groups whose product is made whole
    mine = gather(first_a[small], na[small])
    left = np.repeat(a[mine], each)
    right = b[gather(np.repeat(first_b[small], na[small]), each)]
    keys = (np.repeat(owner[small], links[small]) << 32) | (left * width + right)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys, times = keys[first], np.diff(np.append(first, len(keys)))
    if not small.all():
        parts, sums = [keys], [times]
        for g in np.flatnonzero(~small).tolist():
            (x, p), (y, q) = (np.unique(i[s : s + n], return_counts=True) for i, s, n in ((a, first_a[g], na[g]), (b, first_b[g], nb[g])))
            parts.append((owner[g] << 32) | (x[:, None] * width + y[None, :]).ravel())
            sums.append((p[:, None] * q[None, :]).ravel())
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.bincount(at, np.concatenate(sums), len(keys)).astype(np.int64)
    return keys >> 32, keys & 0xFFFFFFFF, times


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a: str = TOKENIZER, b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times per row: see ``linked_pairs`` for the last two."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n = aligner(a, b), batch.num_rows
        ids_a, ids_b, n_a, n_b = own.encode([x or "" for x in batch.column(1).to_pylist()])
        if not len(ids_a):
            zero, none = pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), zero, zero, zero, zero, pa.array([""] * n), none, none], _NAMES)
        na, nb = group_sizes(np.cumsum(own.a_size[ids_a]), np.cumsum(own.b_size[ids_b]))
        owner = np.searchsorted(np.cumsum(n_a), np.cumsum(na))  # the text whose tokens the group ends among
        groups = np.bincount(owner, minlength=n)
        text, pair, times = linked_pairs(ids_a, ids_b, na, nb, owner, len(own.b_bytes))
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=n))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair, times)]
        links = np.bincount(owner, na * nb, minlength=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_a, n_b, groups, links)), pa.array(own.digests(ids_a, ids_b, na, nb, groups)), *lists], _NAMES)

    return map_text(doc_columns(docs), run, _ALIGNED)


_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]


def frequent(counts: DataFrame, most: int = HELD) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs, sorted, and counts of the most frequent pairs, at most ``most``, and whether these are all."""
    size = F.floor(F.log2("n") * 8).cast("int")
    left, least, every = most, 0, True
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("pairs")).collect(), key=lambda r: -r["size"]):  # a row for each eighth of a power of two
        left -= r["pairs"]
        if left < 0:
            least, every = r["size"] + 1, False
            break
    held = counts.where(size >= least).select("pair", "n").toArrow()
    pair, n = (held.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order], every


def _scored(held, width: int):
    """Sums over the pairs that are broadcast, and the other pairs with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = held.value
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            offsets = pairs.offsets.to_numpy()
            pair, time = (x.values.to_numpy()[offsets[0] : offsets[-1]] for x in (pairs, times))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            n = np.zeros(len(pair), np.int64)
            n[hit] = count[at[hit]]
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner, n * time)  # whole numbers
            top = np.zeros(batch.num_rows, np.int64)
            np.add.at(top, owner, np.where(hit & (n == best[pair // width]), time, 0))
            rest = pa.array(np.append(0, np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(sums), *[pa.ListArray.from_arrays(rest, pa.array(x[~hit])) for x in (pair, time)]], ["row", "n_best", "count_sum", "pairs", "times"])
        trim()

    return run


def align(docs: DataFrame, a: str = TOKENIZER, b: str = PIECES, held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of docs (doc_id, text).

    A row is a document, so repeated rows count and come repeated, and a null doc_id stays null. Texts that are null or empty, and those
    that a tokenizer does not give back byte by byte, have zeros and ''. Very long texts are one row like others: a slice of texts
    is worked on at a time, at least one. Of ids whose best count is shared all links count in n_best. An empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    width = len(aligner(a, b).b_bytes)
    rows = scratch.store(aligned(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "aligned")  # numbers are as stored from here on
    counts = scratch.store(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    best = np.zeros(len(aligner(a, b).a_bytes), np.int64)
    for r in counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("n")).toLocalIterator():  # at most a row for each id of A
        best[r["a"]] = r["n"]
    known, count, every = frequent(counts, held)
    sent = docs.sparkSession.sparkContext.broadcast((known, count, best))
    scored = rows.select("row", "pairs", "times").mapInArrow(_scored(sent, width), "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    kept = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if every:
        return kept.join(scored.select("row", "n_best", "count_sum"), "row").select(columns)
    scored = scratch.store(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    tops = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a long, top long")
    found = rare.join(counts, "pair").withColumn("a", F.floor(F.col("pair") / width)).join(F.broadcast(tops), "a")
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("total"))
    both = scored.select("row", "n_best", "count_sum").join(more, "row", "left")
    sums = both.select("row", (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("total", F.lit(0))).alias("count_sum"))
    return kept.join(sums, "row").select(columns)


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    """``align`` of byte_bpe_50k (A) and piece_bpe_32k (B) over whole texts; see there for nulls, blanks and repeats."""
    return align(docs)
