"""Line dedup by a sharded minimal perfect hash.

Lines long enough are hashed to 128 bits; a map-side combined aggregation counts the documents of
each hash and finds its largest doc_id. Hashes found often enough form the index: split into shards
by their leading bits, each with a minimal perfect hash (levels of bit arrays, after BBHash) over
one half of the hash and arrays of fingerprints (the other half), counts and largest doc_ids at the
places it gives. Documents probe the arrays; lines are never joined. Shards are broadcast in passes
of at most ``pass_bytes``. An index that fits one pass is probed while the texts are read; a larger one
takes more passes, which go over the stored hashes of long lines and give the places of those to
drop, and the texts are touched once at the end. So memory stays bounded and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, as_bytes, doc_columns, parted, slices, text_digest
from corpusloom.llm.textkernel import mix

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, on average, and bytes of shards that one pass broadcasts.
SHARD_KEYS, PASS_BYTES = 1 << 16, 64 << 20
_NO_ID = -(1 << 63)
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped and with A-Z lowered, None if it has too few code points."""
    key = line.strip(_BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


class PerfectHash:
    """A bijection of distinct uint64 keys onto range(n); other keys get any place or -1."""

    GAMMA, LEVELS = 1.5, 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        ones = np.concatenate([*levels, np.zeros(0, bool)])
        self.ranks = np.cumsum(ones, dtype=np.int64)
        self.bases = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < cls.LEVELS:
            size = max(64, int(cls.GAMMA * len(keys)))
            at = cls.place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = self.place(keys[left], i, len(level))
            hit = level[at]
            out[left[hit]] = self.ranks[self.bases[i] + at[hit]] - 1
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = (self.ranks[-1] if len(self.ranks) else 0) + at[hit]
        return out


def _shard_row(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's hash function and arrays as bytes."""
    keys = pdf["h1"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((pdf["h2"].to_numpy(), keys))
    keys, pdf = keys[order], pdf.iloc[order]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]  # an equal first half shares a place: the run's rows follow one another in the arrays
    ph = PerfectHash.build(keys[lead])
    first, run = np.flatnonzero(lead), np.diff(np.append(np.flatnonzero(lead), len(keys)))
    place = ph(keys[lead])
    starts = np.zeros(len(first) + 1, np.int64)
    widths = np.zeros(len(first), np.int64)
    widths[place] = run
    np.cumsum(widths, out=starts[1:])
    to = np.repeat(starts[place], run) + np.arange(len(keys)) - np.repeat(first, run)
    put = lambda name, kind: _scatter(pdf[name].to_numpy(np.int64).astype(kind), to).tobytes()
    row = {
        "shard": int(pdf["shard"].iloc[0]),
        "sizes": [len(x) for x in ph.levels],
        "bits": np.packbits(np.concatenate([*ph.levels, np.zeros(0, bool)])).tobytes(),
        "rest": ph.rest.tobytes(),
        "starts": starts.astype(np.int32).tobytes(),
        "fps": put("h2", np.int64),
        "counts": put("n", np.int64),
        "last": put("last", np.int64),
    }
    return pd.DataFrame([row])


def _scatter(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[to] = values
    return out


class Shard:
    def __init__(self, row: dict):
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        ends = np.cumsum([0, *row["sizes"]])
        self.hash = PerfectHash([bits[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.frombuffer(row["rest"], np.uint64))
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.fps, self.counts, self.last = (np.frombuffer(row[k], np.int64) for k in ("fps", "counts", "last"))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest doc_id of each hash, count zero where the shard has it not."""
        place = self.hash(h1.view(np.uint64))
        count, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        known = np.flatnonzero(place >= 0)
        at, end = self.starts[place[known]], self.starts[place[known] + 1]
        while len(known):
            hit = self.fps[at] == h2[known]
            count[known[hit]], last[known[hit]] = self.counts[at[hit]], self.last[at[hit]]
            more = ~hit & (at + 1 < end)
            known, at, end = known[more], at[more] + 1, end[more]
        return count, last


def _line_hashes(lines: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray]:
    """Positions of the lines with a key, and the two halves of their hashes."""
    where, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
            where.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return where, np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n (different doc_ids, null being one and the smallest), last (largest doc_id) of every long line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, hashes = [], []
                for doc, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    h = _line_hashes(text.split(b"\n"), min_chars)[1]
                    if len(h):
                        h = np.unique(h, axis=0) if len(h) > 1 else h
                        hashes.append(h)
                        ids.append(np.full(len(h), _NO_ID if doc is None else doc, np.int64))
                if ids:
                    h = np.concatenate(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.concatenate(ids))], ["h1", "h2", "doc_id"])

    rows = doc_columns(docs).mapInArrow(run, "h1 long, h2 long, doc_id long")
    return rows.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))


def build_index(scratch: Scratch, counts: DataFrame) -> tuple[DataFrame, int]:
    """One row per shard, and the number of leading bits that tell shards apart."""
    counts = scratch.store(counts, "repeated-lines")
    bits = max(0, (counts.count() // SHARD_KEYS).bit_length())
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)
    schema = "shard int, sizes array<int>, bits binary, rest binary, starts binary, fps binary, counts binary, last binary"
    return scratch.store(counts.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard_row, schema), "line-index"), bits


def _passes(index: DataFrame, most: int) -> list[list[int]]:
    size = sum((F.length(c) for c in ("bits", "rest", "starts", "fps", "counts", "last")), F.lit(0))
    groups: list[list[int]] = []
    room = 0
    for row in index.select("shard", size.alias("bytes")).orderBy("shard").toLocalIterator():
        if not groups or row["bytes"] > room:
            groups.append([])
            room = most
        groups[-1].append(row["shard"])
        room -= row["bytes"]
    return groups


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """row (the input row as a struct), text (kept lines), n_lines, n_dropped, per input row.

    Texts are split at \\n; null or empty is one empty line. A key found under at least ``min_docs``
    different doc_ids loses its lines in all rows but those of the largest doc_id that holds it. Rows of one
    doc_id are one document; all rows with a null doc_id are together one document, the smallest. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    index, bits = build_index(scratch, line_counts(docs, min_chars).where(F.col("n") >= min_docs))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = whole.select("row", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    passes = _passes(index, pass_bytes) or [[]]

    def shards(group: list[int]):
        rows = index.where(F.col("shard").isin(group)).collect() if group else []
        return docs.sparkSession.sparkContext.broadcast({r["shard"]: r.asDict() for r in rows})

    if len(passes) == 1:
        return whole.mapInArrow(_cutter(shards(passes[0]), bits, min_chars), schema)
    lines = scratch.store(doc_columns(docs).withColumn("t", text_digest()).mapInArrow(_hasher(min_chars), "doc_id long, t binary, at array<int>, h1 array<long>, h2 array<long>"), "lines")
    found = None
    for group in passes:
        held = shards(group)
        part = scratch.store(lines.mapInArrow(_prober(held, bits), "doc_id long, t binary, gone array<int>"), "gone")
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    gone = found.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    gone = scratch.store(gone, "lines-gone")
    met, apart = parted(whole.withColumn("_t", text_digest()).withColumn("_doc", F.coalesce("doc_id", F.lit(_NO_ID))), gone)
    joined = met.join(gone, ["_doc", "_t"], "left").unionByName(apart.withColumn("gone", F.lit(None).cast("array<int>")))
    return joined.select("row", "doc_id", "text", "gone").mapInArrow(_cutter(None, bits, min_chars), schema)


def _gone(shards: dict[int, Shard], bits: int, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which lines (hashes and doc_ids) an index of these shards takes away."""
    out = np.zeros(len(h), bool)
    of = (h[:, 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    for k, shard in shards.items():
        own = np.flatnonzero(of == k)
        count, last = shard.probe(np.ascontiguousarray(h[own, 0]), h[own, 1])
        out[own] = (count > 0) & (last != doc[own])
    return out


def _hasher(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [_line_hashes(x.split(b"\n"), min_chars) for x in as_bytes(part.column(1))]
                columns = [pa.array([x[0] for x in found], pa.list_(pa.int32())), *(pa.array([x[1][:, c] for x in found], pa.list_(pa.int64())) for c in (0, 1))]
                rows = pa.RecordBatch.from_arrays([part.column(0).fill_null(_NO_ID), part.column(2), *columns], ["doc_id", "t", "at", "h1", "h2"])
                yield rows.filter(pa.array([bool(x[0]) for x in found]))

    return run


def _prober(held, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard(row) for k, row in held.value.items()}
        for b in batches:
            sizes = np.diff(b.column(2).offsets.to_numpy())
            h = np.stack([b.column(c).flatten().to_numpy() for c in (3, 4)], 1)
            gone = _gone(shards, bits, h, np.repeat(b.column(0).to_numpy(), sizes))
            at = b.column(2).flatten().to_numpy()
            cuts = np.cumsum(sizes)[:-1]
            rows = [x[g] for x, g in zip(np.split(at, cuts), np.split(gone, cuts), strict=True)] if b.num_rows else []
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "t", "gone"])
            yield out.filter(pa.array([len(x) > 0 for x in rows], pa.bool_()))

    return run


def _cutter(held, bits: int, min_chars: int):
    """Texts without the lines that the shards take away, or that ``gone`` (the fourth column) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard(row) for k, row in held.value.items()} if held is not None else {}
        for batch in batches:
            for part in slices(batch, 2):
                texts = [x.split(b"\n") for x in as_bytes(part.column(2))]
                if held is not None:
                    found = [_line_hashes(x, min_chars) for x in texts]
                    h = np.concatenate([np.zeros((0, 2), np.int64), *(x[1] for x in found)])
                    sizes = [len(x[0]) for x in found]
                    gone = _gone(shards, bits, h, np.repeat(part.column(1).fill_null(_NO_ID).to_numpy(), sizes))
                    ends = np.cumsum([0, *sizes]).tolist()
                    outs = [{where[j] for j in np.flatnonzero(gone[a:b])} for (where, _), a, b in zip(found, ends[:-1], ends[1:], strict=True)]
                else:
                    outs = [set(x or ()) for x in part.column(3).to_pylist()]
                kept = [b"\n".join([x for i, x in enumerate(own) if i not in out] if out else own) for own, out in zip(texts, outs, strict=True)]
                columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in outs], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["row", "text", "n_lines", "n_dropped"])

    return run


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines out of text, and n_chars (if there) the new length.

    Every row stays, repeated rows as often as they come; null texts stay null. See ``drop_lines`` for rows that share a
    doc_id or have none. An empty table gives an empty result; further columns pass through.
    """
    kept = drop_lines(docs)
    known = F.col("row.text").isNotNull()
    new = {"text": F.when(known, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(known, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row; see ``drop_lines`` for nulls, blanks and repeated rows."""
    found = drop_lines(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row_no, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
marked AS (
  SELECT keyed.*, often.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM often.last AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
