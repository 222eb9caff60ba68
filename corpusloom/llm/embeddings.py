"""Embedding near-duplicates by random-hyperplane sign hashing.

Vectors of one label meet in several tables, each by the signs of a few random projections. Bits grow with the
logarithm of the largest label, so buckets keep their size, and tables follow so that a pair at the threshold
meets in none with a chance of at most MISS. Only numbers and SKETCH further signs of each vector go to the tables:
pairs whose sketches differ in too many signs are put aside (at the threshold this happens with a chance of at most
SKETCH_MISS), each other pair is a candidate once, and its vectors are fetched once for the exact cosine in double precision.

Equal vectors are one point with a multiplicity. Where a bucket has many candidates for its size, its points are
close to one another, and pairs are not made: the candidates' spanning forest puts the points together, groups of
such points are compared as blocks by blocks, and give back only link counts and a spanning forest of the
links. Buckets of more than CROWD points are dealt out as blocks too. Components come from the distributed contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.llm.blocks import BUCKET_ROWS, SKETCH, binomial_bound, bucket_rows, candidates, dealt, roots, runs, tables_for
from corpusloom.llm.common import Scratch
from corpusloom.llm.graph import connected_components

THRESHOLD, MISS = 0.93, 1e-5
#: The chance that a pair at the threshold is put aside by its sketches.
SKETCH_MISS = 1e-6
#: Points that a bucket should have, and points of a block of vectors.
BUCKET, BLOCK = 32, 256
_SEED = 20


def plan_for(points: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and tables, for the points of the largest label."""
    bits = max(4, math.ceil(math.log2(max(1, points) / BUCKET)))
    return bits, tables_for(bits, math.acos(threshold) / math.pi, miss)


@cache
def _planes(size: int, n: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((size, n))


def signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Of unit vectors: the sketch, then the signs of all tables, as bytes of a row each."""
    return np.packbits(x @ _planes(x.shape[1], SKETCH + bits * tables) > 0, axis=1, bitorder="little")


def _points(bits: int, tables: int, kind: str):
    """vec_id, label, vec (its numbers as bytes, as wide as they came), h1, h2, signs; the last four null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, h = [], []
            labels = batch.column(1).to_pylist()
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, label in enumerate(labels):
                x = flat[offsets[i] : offsets[i + 1]] + flat.dtype.type(0)  # -0.0 becomes 0.0
                ok = label is not None and present[i] and bool(np.isfinite(x).all()) and bool(x.any())
                vec.append(x.tobytes() if ok else None)
                h.append(np.frombuffer(xxhash.xxh3_128_digest(vec[-1] + repr(label).encode()), ">i8").tolist() if ok else (None, None))
            found: list[bytes | None] = [None] * len(vec)
            sizes = np.array([len(v or b"") for v in vec])
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                for i, row in zip(own.tolist(), signs(_unit([vec[i] for i in own], kind), bits, tables), strict=True):
                    found[i] = row.tobytes()
            columns = [batch.column(0), batch.column(1), pa.array(vec, pa.binary()), pa.array([a for a, _ in h], pa.int64()), pa.array([b for _, b in h], pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vec", "h1", "h2", "signs"])

    return run


def _unit(vecs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), kind).astype(np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay within range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                kind = np.array([xxhash.xxh3_64_intdigest(f"{label} {size}".encode()) for label, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], np.uint64)
                yield bucket_rows(b.column(0).to_numpy(), packed, kind, bits, tables)

    return run


def _verified(threshold: float, kind: str):
    """Of pairs with their vectors (a, b, x, y), those at the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2).to_pylist()])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x, y = (_unit(part.column(c).to_pylist(), kind) for c in (2, 3))
                yield part.select([0, 1]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    return run


def _compare(node: np.ndarray, n: np.ndarray, block: np.ndarray, x: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts and spanning edges among the points of one comparison."""
    order = np.lexsort((node, block))
    node, n, block, x = node[order], n[order], block[order], x[order]
    if cross:
        cut = int(np.searchsorted(block, block[0], side="right"))
        a, b = np.nonzero(x[:cut] @ x[cut:].T >= threshold)
        b = b + cut
    else:
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
    return node, links.astype(np.int64), node[roots(len(node), a, b)]


def _blocks(threshold: float, kind: str):
    """node, links, root of the groups' blocks; columns part, i, j, own, node, n, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            block = part.column(3).to_numpy()
            cross = part.column(1)[0] != part.column(2)[0]
            if part.num_rows < 2 or (cross and (block == block[0]).all()):
                continue
            x = _unit(part.column(6).to_pylist(), kind)
            node, links, root = _compare(part.column(4).to_numpy(), part.column(5).to_numpy(), block, x, cross, threshold)
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(root[hit])], ["node", "links", "root"])

    return run


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id per row of vectors (vec_id, label, embedding).

    Vectors link only within a label and with as many components. Null, empty and zero vectors, those
    with null or non-finite components and those with a null label link with nothing and are their
    own component. Every row is a vector, so repeated rows link with one another. A row with a null vec_id
    counts as a link of others and connects them, and has no component_id where no row it reaches has a vec_id.
    An empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    number, kind = ("float", "<f4") if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    largest = rows.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_for(largest, threshold)
    found = rows.mapInArrow(_points(bits, tables, kind), "vec_id long, label long, vec binary, h1 long, h2 long, signs binary")
    points = scratch.store(found.withColumn("node", F.monotonically_increasing_id()), "points")  # numbers are as stored from here on
    groups = points.where("h1 is not null").groupBy("h1", "h2").agg(F.min("node").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("label").alias("label"), F.min(F.length("vec")).alias("size"), F.min("signs").alias("signs"))
    groups = scratch.store(groups, "groups")

    entries = groups.select("node", "label", "size", "signs").mapInArrow(_entries(bits, tables), BUCKET_ROWS)
    near = candidates(scratch, entries, binomial_bound(SKETCH, math.acos(threshold) / math.pi, SKETCH_MISS))

    parts = connected_components(scratch, near.where("dense").select("a", "b"))
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    pairs = near.where("NOT dense").select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_part IS NULL OR b_part IS NULL OR a_part <> b_part").select("a", "b")
    vec = points.select("node", "vec")
    both = pairs.join(vec.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(vec.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
    linked = scratch.store(both.select("a", "b", "x", "y").mapInArrow(_verified(threshold, kind), "a long, b long"), "linked")

    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    members = parts.join(sizes, "component").join(groups.select("node", "n"), "node").join(vec, "node")
    spread = dealt(members, "nb").select("component", "i", "j", "own", "node", "n", "vec")
    spread = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    compared = scratch.store(spread.mapInArrow(_blocks(threshold, kind), "node long, links long, root long"), "links")

    times = groups.select("node", "n")
    apart = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(times.select(F.col("node").alias("b"), "n"), "b")
    links = compared.select("node", "links").unionByName(apart.select(F.col("a").alias("node"), F.col("n").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    edges = linked.unionByName(compared.where("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"))).distinct()
    joined = groups.select("h1", "h2", "node", "rep", "n").join(links, "node", "left").join(connected_components(scratch, edges), "node", "left")
    named = scratch.store(joined.select("h1", "h2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("part")), "named")
    least = named.groupBy("part").agg(F.min("rep").alias("component"))
    named = scratch.store(named.join(least, "part").select("h1", "h2", "links", "component"), "components")
    result = points.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))


def op10_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept (whether vec_id is component_id) per row; see ``embedding_components`` for nulls and repeats.

    kept is null where vec_id is, and repeated rows of a kept vec_id are all kept.
    """
    return embedding_components(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
