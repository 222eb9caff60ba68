"""SimHash near-dedup at a similarity: pigeonhole blocks of long fingerprints propose, exact Jaccard decides.

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more differ in at most about 15 % of the bits of
a SimHash: too many for the whole blocks of 64 bits to agree. So a fingerprint here has as many bits as it takes. It is cut
into blocks; two fingerprints that differ in fewer bits than there are blocks surely share one, and a pair at the threshold
shares none with a chance of at most MISS. Documents join on blocks, the Hamming distance is verified, first of SKETCH further bits, which
travel along, then of the whole fingerprints (each puts aside a pair at the threshold with a chance of at most SKETCH_MISS), and the shingle sets of what is left decide exactly. A block's bits grow with the logarithm
of the documents, so buckets keep their size. Documents of equal shingle sets are one point. Points of a bucket that are close to
one another are not paired: groups of them are compared all by all, as blocks by blocks, first by their whole fingerprints, which
parts them into groups of their own, then these by their shingle sets; each time only a spanning forest is given back.
Components come from the distributed contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import BUCKET_ROWS, SKETCH, binomial_bound, bucket_rows, candidates, close, dealt, roots, runs, tables_for
from corpusloom.llm.common import Scratch, as_bytes, doc_columns, keep_one, map_text, parted, text_digest
from corpusloom.llm.graph import connected_components
from corpusloom.llm.simhash import shingle_hashes
from corpusloom.llm.textkernel import mix

SIZE, THRESHOLD, MISS, SKETCH_MISS = 5, 0.8, 1e-6, 1e-6
#: Least bits of a block, documents that a bucket should have at most, points of a block of fingerprints and of one of sets, shingles compared at a time.
LEAST_BITS, BUCKET, PRINTS, BLOCK, COLUMNS = 12, 64, 2048, 256, 4096
_AT_ONCE = 4096


def apart(threshold: float) -> float:
    """The share of bits that differ at a Jaccard similarity: sets of equal sizes have the cosine 2 j / (1 + j), others a larger one."""
    return math.acos(2 * threshold / (1 + threshold)) / math.pi


def plan_for(docs: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a block, and blocks."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, docs) / BUCKET)))
    return bits, tables_for(bits, apart(threshold), miss)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct shingles' hashes in order; none without words."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def long_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """A bit is 1 if set in over half the hashes, each of which gives 64 bits for every word."""
    counts = np.zeros(64 * words, np.int64)
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), _AT_ONCE):
        own = mix(hashes[i : i + _AT_ONCE, None] + steps[None, :])
        counts += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _key(hashes: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").tolist()


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return shared >= threshold * (a + b - shared) - 1e-9


def _close(bound: int):
    """Of pairs with their fingerprints (a, b, x, y), those that differ in at most ``bound`` bits of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= bound))

    return run


def _verified(threshold: float):
    """Of pairs with their shingle sets (a, b, x, y), those at the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                keep[i] = similar(np.isin(x, y, assume_unique=True).sum(), len(x), len(y), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def block_links(nodes: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges node, root that connect what pairs of similar sets connect."""
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[place]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(common.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    a, b = np.nonzero(np.triu(similar(shared, sizes[:, None], sizes[None, :], threshold), 1))
    root = nodes[roots(len(sets), a, b)]
    return nodes[root != nodes], root[root != nodes]


def _alike(bound: int):
    """Edges that connect what pairs of fingerprints connect that differ in at most ``bound`` bits; columns component, i, j, own, node, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            block = part.column(3).to_numpy()
            order = np.argsort(block, kind="stable")
            block, node = block[order], part.column(4).to_numpy()[order]
            prints = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint64).reshape(len(node), -1)[order]
            cut = None if part.column(1)[0] == part.column(2)[0] else int(np.searchsorted(block, block[0], side="right"))
            root = roots(len(node), *close(prints, bound, cut))
            others = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[others]]), pa.array(node[others])], ["a", "b"])

    return run


def _blocks(threshold: float):
    """Edges of groups' blocks; columns component, i, j, node, hashes."""

    def links(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            a, b = block_links(np.array([n for n, _ in held], np.int64), [np.frombuffer(s, np.uint64) for _, s in held], threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for *key, node, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    yield from links(held)
                    last, held = key, []
                held.append((node, hashes))
        yield from links(held)

    return run


def _spread(groups: DataFrame, most: int) -> DataFrame:
    """component, i, j, own, node: members of groups, dealt out as pairs of blocks of about ``most``."""
    counts = groups.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("nb"))
    return dealt(groups.join(counts, "component"), "nb").select("component", "i", "j", "own", "node")


def _parts(scratch: Scratch, docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, points). rows: doc_id, t, k1, k2 per row with a doc_id; points: k1, k2 (digest of the shingle set), rep (its least doc_id), part."""
    texts = doc_columns(docs).where("doc_id is not null").withColumn("t", text_digest())
    bits, tables = plan_for(texts.count(), threshold)
    words = -(-(SKETCH + bits * tables) // 64)

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, size) for x in as_bytes(batch.column(1))]
        keys = [_key(s) for s in sets]
        prints = [long_fingerprint(s, words) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([k[c] for k in keys], pa.int64()) for c in (0, 1)), pa.array(prints, pa.binary())], ["doc_id", "t", "k1", "k2", "fp"])

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).tobytes() for x in as_bytes(batch.column(1))], pa.binary())], ["node", "hashes"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                yield bucket_rows(b.column(0).to_numpy(), packed, np.zeros(b.num_rows, np.uint64), bits, tables)

    rows = scratch.store(map_text(texts, signed, "doc_id long, t binary, k1 long, k2 long, fp binary"), "signed")
    points = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.min("fp").alias("fp"))
    points = scratch.store(points.withColumn("node", F.monotonically_increasing_id()), "points")  # numbers are as stored from here on
    entries = points.where("fp is not null").select("node", "fp").mapInArrow(entered, BUCKET_ROWS)
    near = candidates(scratch, entries, binomial_bound(SKETCH, apart(threshold), SKETCH_MISS))
    loose = connected_components(scratch, near.where("dense").select("a", "b"))
    of = lambda c: loose.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    pairs = near.where("NOT dense").select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_part IS NULL OR b_part IS NULL OR a_part <> b_part").select("a", "b")
    prints = points.select("node", "fp")
    both = pairs.join(prints.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a").join(prints.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
    bound = binomial_bound(64 * words, apart(threshold), SKETCH_MISS)
    pairs = scratch.store(both.select("a", "b", "x", "y").mapInArrow(_close(bound), "a long, b long"), "pairs")
    spread = _spread(loose, PRINTS).join(prints, "node").select("component", "i", "j", "own", "node", "fp")
    spread = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    groups = connected_components(scratch, spread.mapInArrow(_alike(bound), "a long, b long").distinct())

    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    wanted = scratch.store(points.join(met, "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.t").alias("_t")), "wanted")
    own = parted(texts.select("text", F.col("doc_id").alias("_doc"), F.col("t").alias("_t")), wanted)[0].join(wanted, ["_doc", "_t"])
    sets = scratch.store(map_text(own.select("node", "text"), listed, "node long, hashes binary").dropDuplicates(["node"]), "sets")
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    linked = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long")
    spread = _spread(groups, BLOCK).join(sets, "node")
    spread = spread.select("component", "i", "j", "node", "hashes").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    edges = linked.unionByName(spread.mapInArrow(_blocks(threshold), "a long, b long").distinct())
    parts = connected_components(scratch, edges)
    return rows, scratch.store(points.join(parts, "node", "left").select("k1", "k2", F.col("first.doc_id").alias("rep"), F.coalesce("component", "node").alias("part")), "parts")


def near_components(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable by links of at least ``threshold`` shared shingles (Jaccard).

    One row per row with a doc_id. Texts without words are equal; a text shorter than a shingle is one. Rows of one
    doc_id with different texts stand for themselves. An empty table gives an empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows, points = _parts(scratch, docs, size, threshold)
    least = points.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = scratch.store(points.join(least, "part").select("k1", "k2", "component_id"), "named")
    return rows.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "component_id")


def near_keep(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, that of least doc_id, as do all rows without doc_id.

    Rows of one doc_id stand for themselves: each goes or stays with its own text's component. Null texts count as
    empty, repeated rows stay once, an empty table gives an empty result, further columns pass through.
    """
    scratch = Scratch(docs.sparkSession)
    rows, points = _parts(scratch, docs, SIZE, THRESHOLD)
    return keep_one(scratch, docs, rows.join(points.select("k1", "k2", "part"), ["k1", "k2"]).select("doc_id", "t", "part"))
