"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes (of a document's words) only those at minimisers are kept: the place of the least hash of
GRAM words in each window of ``min_words``. A passage of ``min_words`` words chooses the same minimiser
wherever it stands. The kept suffixes are sorted over the cluster by their leading LEAD words, then by
document, and neighbours are compared by these words. Where neighbours of different documents agree, their
matches are extended from the minimiser left and right, word by word, as far as a run of ``min_words`` words
around it can reach. Each window is looked at under the minimiser that it chose. A run of ``min_words`` words is a repeat where a document of smaller doc_id has it too;
overlapping repeats make a span. Longer passages hold a minimiser every few words, so their spans join.

Suffixes that agree are extended together: the members of a group get numbers for their j words to the
left and their k words to the right, equal exactly where those words are, so that a group costs in proportion to
its size and no pairs are made. A group of more than HOT suffixes is not gathered in one task: its runs of
words are told apart by 128-bit digests in a map-side combined minimum, to the same result.
Hashes choose places and deal out work; equality is that of words, or of 128-bit digests in crowded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, as_bytes, doc_columns, map_text, parted, slices, text_digest, trim
from corpusloom.llm.textkernel import Texts, distinct, exact_keys, running, spans

MIN_WORDS, GRAM, LEAD = 50, 16, 8
#: Suffixes of a group that one task extends, and those that one numpy pass works on at least.
HOT, AT_ONCE = 32_768, 4_096
_KEY = "doc_id long, t binary, "


class Suffixes:
    """The words of texts and the suffixes kept: ``at``, their places as numbers of words, and the first and last window that chose each."""

    def __init__(self, texts: list[bytes], min_words: int = MIN_WORDS, gram: int = GRAM):
        t = self.texts = Texts(texts)
        self.starts, self.ends, self.owner = t.words()
        self.counts = np.bincount(self.owner, minlength=t.n)
        self.first = np.cumsum(self.counts) - self.counts
        self.at = self.low = self.high = np.zeros(0, np.int64)
        n = len(self.starts) - min_words + 1
        if n <= 0:
            return
        sums = running(t.hashes(self.starts, self.ends))
        place = np.arange(len(self.starts) - gram + 1)
        least = spans(sums, place, place + gram)
        width, have = min_words - gram + 1, 1
        while have < width:  # least[i] and its place are over ``have`` hashes from i on, the leftmost of equals
            step = min(have, width - have)
            right = least[step:] < least[: len(least) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            least = np.where(right, least[step:], least[: len(least) - step])
            have += step
        windows = np.flatnonzero(self.owner[:n] == self.owner[min_words - 1 :])
        self.at, first, count = np.unique(place[windows], return_index=True, return_counts=True)
        self.low = windows[first]  # a place is chosen by windows that follow one another
        self.high = self.low + count - 1


def packed(at: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A suffix as one number: its place, and the most and least words that the windows which chose it have before it."""
    return at << 32 | most << 16 | least


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code >> 32, code >> 16 & 0xFFFF, code & 0xFFFF


def _parse(min_words: int, gram: int):
    """A row for each text with its number of words (at -1), and a row for each suffix kept, with its leading words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Suffixes(as_bytes(batch.column(1)), min_words, gram)
        raw = s.texts.data.tobytes()
        own = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[s.owner[s.at]]
        at, most, least = s.at[own], (s.at - s.low)[own], (s.at - s.high)[own]
        words = [b" ".join(raw[a:b].split()) for a, b in zip(s.starts[at].tolist(), s.ends[at + min(LEAD, gram) - 1].tolist(), strict=True)]
        rows = pa.array(np.concatenate([np.arange(s.texts.n), s.owner[at]]))
        places = np.concatenate([np.full(s.texts.n, -1), packed(at - s.first[s.owner[at]], most, least)])
        lead = pa.array([None] * s.texts.n + words, pa.binary())
        n_words = pa.array(s.counts.astype(np.int64)).take(rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), n_words, pa.array(places), lead], ["doc_id", "t", "n_words", "at", "lead"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by (lead, doc_id), those whose leading words another document's neighbour has; a range's first and last group too."""
    held: pa.Table | None = None  # the last group, as far as it is of one document
    crossed, first = None, True  # the last group's words if it is known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        lead = t["lead"].chunk(0)
        begin = np.concatenate([[0], np.flatnonzero(pc.not_equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False)) + 1])
        doc = t["doc_id"].to_numpy()
        shared = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        shared[0] |= first or (crossed is not None and lead[0].as_py() == crossed)
        keep = np.repeat(shared, np.diff(np.append(begin, len(doc))))
        crossed = lead[len(lead) - 1].as_py() if shared[-1] else None
        held = None if shared[-1] else t.slice(int(begin[-1]))
        first = False
        yield from t.select(["doc_id", "t", "at"]).filter(pa.array(keep)).to_batches()
    if held is not None:
        yield from held.select(["doc_id", "t", "at"]).to_batches()


def _contexts(min_words: int, gram: int):
    """For each suffix wanted, the words before and after it that the windows which chose it hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(as_bytes(part.column(1)))
                starts, ends, owner = t.words()
                counts = np.bincount(owner, minlength=t.n)
                base = np.cumsum(counts) - counts
                wanted = part.column(3)
                rows = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                codes = wanted.flatten().to_numpy()
                at, most, least = unpacked(codes)
                low, high = at - most, at - least + min_words
                cut = lambda a, b: [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                raw, here = t.data.tobytes(), base[rows]
                begin = starts[here + at]
                left, right = cut(starts[here + low], begin), cut(begin, ends[here + high - 1])
                lead = [xxhash.xxh3_64_intdigest(b" ".join(x.split())) - (1 << 63) for x in cut(begin, ends[here + at + gram - 1])]
                ids = part.select([0, 2]).take(pa.array(rows))
                columns = [pa.array(lead, pa.int64()), *ids.columns, pa.array(codes), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "doc_id", "t", "at", "left", "right"])
        trim()

    return run


def extend(group: np.ndarray, doc: np.ndarray, code: np.ndarray, left: list[bytes], right: list[bytes], min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``min_words`` words that a member of smaller ``doc`` in the same group has too: (member, words before its suffix, the least such doc)."""
    n = len(group)
    t = Texts([*left, *right])
    starts, ends, owner = t.words()
    word = distinct(*exact_keys(t.data, starts, ends, {}))[1] if len(starts) else np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=2 * n)
    base = np.cumsum(counts) - counts
    before, after = counts[:n], counts[n:]

    def numbers(have: np.ndarray, place, most: int) -> list[np.ndarray]:
        """For each k up to ``most``, numbers of members equal exactly where group and k words are; -1 where there are fewer."""
        out = [np.unique(group, return_inverse=True)[1].ravel()]
        for k in range(most):
            own = np.flatnonzero(have > k)
            step = np.full(n, -1, np.int64)
            step[own] = np.unique(out[-1][own] * (len(word) + 1) + word[place(k)[own].clip(0, len(word) - 1)], return_inverse=True)[1].ravel()
            out.append(step)
        return out

    lefts = numbers(before, lambda k: base[:n] + before - 1 - k, min_words - gram)
    rights = numbers(after, lambda k: base[n:] + k, min_words)
    _, most, fewest = unpacked(code)
    found = []
    for j in range(min_words - gram + 1):
        own = np.flatnonzero((fewest <= j) & (j <= most))
        if not len(own):
            continue
        at = np.unique(lefts[j][own] * (n + 1) + rights[min_words - j][own], return_inverse=True)[1].ravel()
        least = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, at, doc[own])
        hit = least[at] < doc[own]
        found.append((own[hit], np.full(int(hit.sum()), j), least[at[hit]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def _extended(min_words: int, gram: int):
    """Whole groups at a time: for each suffix with repeats around it the words they cover, and the documents that have them first."""
    kind = pa.list_(pa.int64())

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, doc, code = (t[c].to_numpy() for c in ("k", "doc_id", "at"))
        at = unpacked(code)[0]
        member, j, first = extend(group, doc, code, t["left"].to_pylist(), t["right"].to_pylist(), min_words, gram)
        if not len(member):
            return
        order = np.lexsort((first, member))
        member, j, first = member[order], j[order], first[order]
        begin = np.concatenate([[0], np.flatnonzero(member[1:] != member[:-1]) + 1])
        rows = member[begin]
        start = at[rows] - np.maximum.reduceat(j, begin)
        end = at[rows] - np.minimum.reduceat(j, begin) + min_words
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (first[1:] != first[:-1])
        offsets = np.append(np.cumsum(new)[begin] - 1, int(new.sum())).astype(np.int32)
        firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(first[new])).cast(kind)
        ids = t.select(["doc_id", "t"]).take(pa.array(rows)).combine_chunks()
        yield pa.RecordBatch.from_arrays([ids["doc_id"].chunk(0), ids["t"].chunk(0), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), firsts], ["doc_id", "t", "start", "end", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < AT_ONCE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = t["k"].to_numpy()
            whole = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if whole:
                yield from settle(t.slice(0, whole))
            held = t.slice(whole).to_batches()
            size = len(k) - whole
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())
        trim()

    return run


def _digests(min_words: int, gram: int):
    """The 128-bit digest of each run of ``min_words`` words around a suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, places, found = [], [], []
                for i, (code, left, right) in enumerate(zip(*(part.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                    words, low = [*left.split(), *right.split()], (code >> 32) - (code >> 16 & 0xFFFF)
                    for a in range(len(words) - min_words + 1):
                        rows.append(i)
                        places.append(low + a)
                        found.append(xxhash.xxh3_128_digest(b" ".join(words[a : a + min_words])))
                ids = part.select([1, 2]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *ids.columns, pa.array(places, pa.int32())], ["w", "doc_id", "t", "start"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        for found in batch.column(2).to_pylist():
            own: list[dict] = []
            for x in sorted(found, key=lambda x: (x["start"], x["end"])):
                if own and x["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], x["end"])
                else:
                    own.append({"start": x["start"], "end": x["end"]})
            rows.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind), batch.column(3)], ["doc_id", "t", "spans", "first_docs"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(info, found). info: doc_id, t (digest of the text), n_words, copy_of (least doc_id with the same text, if smaller), per row.
    found: doc_id, t, spans, first_docs (the smallest doc_ids that hold its repeats, which keep them), per doc_id and text.

    spans are [start, end) in words: every run of ``min_words`` words or more that a document of
    smaller doc_id has as well, overlapping ones joined. A whole copy of at least ``min_words`` words is one
    span. Rows of one doc_id with different texts are told apart by the texts; they are one document, so what they have in common
    is no repeat. Rows with a null doc_id, null or
    empty texts and texts under ``min_words`` words have none. An empty table gives empty results.
    """
    scratch = Scratch(docs.sparkSession)
    docs = doc_columns(docs).withColumn("t", text_digest())
    parsed = scratch.store(map_text(docs, _parse(min_words, gram), _KEY + "n_words long, at long, lead binary"), "suffixes")
    info = parsed.where("at < 0").select("doc_id", "t", "n_words")
    long = info.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    firsts = scratch.store(long.groupBy("t").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("top")).where("copy_of < top").drop("top"), "first-copies")
    copies = scratch.store(long.join(firsts, "t").where("doc_id > copy_of").select("doc_id", "t", "n_words", "copy_of").distinct(), "copies")

    suffixes = parsed.where("at >= 0").select("lead", "doc_id", "t", "at")
    ordered = suffixes.repartitionByRange("lead", "doc_id").sortWithinPartitions("lead", "doc_id")
    alike = ordered.mapInArrow(_shared, _KEY + "at long").groupBy("doc_id", "t").agg(F.collect_list("at").alias("ats"))
    seeds = scratch.store(alike.join(copies, ["doc_id", "t"], "left_anti"), "seeds")
    info = scratch.store(info, "texts")
    scratch.drop(parsed)
    met = parted(docs.select("text", F.col("doc_id").alias("_doc"), F.col("t").alias("_t")), seeds.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")))[0]
    met = met.join(seeds.withColumnsRenamed({"doc_id": "_doc", "t": "_t"}), ["_doc", "_t"])
    around = met.select(F.col("_doc").alias("doc_id"), "text", F.col("_t").alias("t"), "ats").mapInArrow(_contexts(min_words, gram), "k long, doc_id long, t binary, at long, left binary, right binary")
    around = scratch.store(around, "contexts")
    crowds = scratch.store(around.groupBy("k").count().where(F.col("count") > HOT).select("k"), "crowds")
    none_crowded = crowds.isEmpty()
    few = around if none_crowded else around.join(crowds, "k", "left_anti").select(*around.columns)
    columns = _KEY + "start int, end int, firsts array<long>"
    found = few.repartition("k").sortWithinPartitions("k").mapInArrow(_extended(min_words, gram), columns)
    if not none_crowded:
        windows = scratch.store(around.join(crowds, "k", "left_semi").select(*around.columns).mapInArrow(_digests(min_words, gram), "w binary, doc_id long, t binary, start int"), "windows")
        least = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("top")).where("first < top").select("w", "first")
        again = windows.join(scratch.store(least, "first-windows"), "w").where("doc_id > first")
        found = found.unionByName(again.select("doc_id", "t", "start", (F.col("start") + min_words).alias("end"), F.array("first").alias("firsts")))
    found = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "end")).alias("found"), F.array_distinct(F.flatten(F.collect_set("firsts"))).alias("first_docs"))
    found = found.mapInArrow(_merged, _KEY + "spans array<struct<start:int,end:int>>, first_docs array<long>")
    whole = copies.select("doc_id", "t", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"), F.array("copy_of").alias("first_docs"))
    found = scratch.store(found.unionByName(whole), "spans")
    scratch.drop(around)
    return info.join(copies.select("doc_id", "t", "copy_of"), ["doc_id", "t"], "left"), found


def cut_spans(text: bytes, found: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each."""
    t = Texts([text])
    starts, ends, _ = t.words()
    kept, at = [], 0
    for a, b in found:
        if a >= len(starts):
            break
        kept.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    kept.append(text[at:])
    return b"".join(kept)


def suffix_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut from all but the smallest doc_id, n_chars (if there) the new length.

    Rows of which no word is left go; all others stay, those without repeats untouched, null texts and rows
    with a null doc_id among them. Each row is cut by its own text's spans, also where rows share a doc_id;
    repeated rows come repeated. An empty table gives an empty result; further columns pass through.
    """
    found = repeated_spans(docs, min_words)[1].select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_digest().alias("_t"))
    met, apart = parted(rows, found)
    joined = met.join(found, ["_doc", "_t"], "left").select("row", F.col("row.text").cast("string").alias("text"), "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, gone = [], []
        for text, own in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            after = cut_spans(text, [(x["start"], x["end"]) for x in own]) if own else text
            new.append(after)
            gone.append(bool(own) and not after.split())
        whole = pa.array(new, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), whole, pa.array(gone)], ["row", "text", "gone"])

    schema = joined.select("row", "text", F.lit(False).alias("gone")).schema
    kept = map_text(joined, run, schema).where("NOT gone").select("row", "text").unionByName(apart.select("row", F.col("row.text").cast("string").alias("text")))
    known = F.col("row.text").isNotNull()
    new = {"text": F.when(known, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(known, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated (words in spans), repeated (whether there are any), spans, first_docs, copy_of: one row per row.

    The smallest doc_id that holds a passage keeps it, so its own row has no span for it. See ``repeated_spans`` for nulls, blanks, repeated rows and doc_ids.
    """
    info, found = repeated_spans(docs)
    n = F.col("n_repeated")
    count = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rows = info.join(found, ["doc_id", "t"], "left").withColumn("n_repeated", F.coalesce(count, F.lit(0).cast("long")))
    none = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    return rows.select("doc_id", "n_words", "n_repeated", (n > 0).alias("repeated"), F.coalesce("spans", none("struct<start:int,end:int>")).alias("spans"), F.coalesce("first_docs", none("long")).alias("first_docs"), "copy_of")
