"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``distance + spare`` blocks. Two fingerprints that differ in at most
``distance`` bits agree on some ``spare`` whole blocks, so equi-joins on each choice of that many blocks find every
close pair, and the Hamming distance decides. Equal fingerprints are folded before the join, so
copies cost one row. Blocks with many members do not join all pairs: each member is listed under
itself and its one-bit neighbours (within the bits that the block leaves free), and members that
share such a point are linked to the least of them. Two fingerprints share a point exactly if they
differ in at most two bits, so that is exact too and grows in proportion to the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, as_bytes, doc_columns, keep_one, map_text, text_digest
from corpusloom.llm.graph import connected_components

#: Members of a block from which one-bit neighbours replace the join of pairs.
HOT_BLOCK = 64
_AT_ONCE = 16_384


def shingle_hashes(text: bytes, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``size`` lower-cased words."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and split() takes \x20 and \x09-\x0D
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), 42)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    return [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 if set in over half the shingles' hashes; zero without words."""
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = np.unpackbits(hashes[i : i + _AT_ONCE].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, t (digest of the text), fp (the 64 bits as a long) of each row; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, size) for x in as_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "t", "fp"])

    return map_text(doc_columns(docs).withColumn("t", text_digest()), run, "doc_id long, t binary, fp long")


def _masks(distance: int, spare: int) -> list[int]:
    blocks, at = [], 0
    for i in range(distance + spare):
        width = (64 - at) // (distance + spare - i)
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(scratch: Scratch, points: DataFrame, distance: int = 2, spare: int = 3, hot: int = HOT_BLOCK) -> DataFrame:
    """Edges a, b that connect what is connected by pairs of at most ``distance`` bits. points: fp, rep (distinct fp)."""
    if distance != 2:
        raise ValueError("crowded blocks are linked through one-bit neighbours, which holds for distance 2")
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(_masks(distance, spare))]
    listed = points.select("fp", "rep", F.explode(F.array(*keys)).alias("s")).select("fp", "rep", "s.t", "s.k")
    sizes = scratch.store(listed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    members = scratch.store(listed.join(sizes, ["t", "k"]), "members")
    few = members.where(F.col("n") <= hot)
    a, b = few.select("t", "k", F.col("fp").alias("fa"), F.col("rep").alias("a")), few.select("t", "k", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    joined = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    points_of: Column = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    crowd = members.where(F.col("n") > hot).select("fp", "rep").distinct()
    shared = crowd.select("rep", F.explode(points_of).alias("p")).groupBy("p").agg(F.collect_list("rep").alias("reps"))  # at most 65 each
    linked = shared.where(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a < b")
    return joined.unionByName(linked).distinct()


def _parts(scratch: Scratch, docs: DataFrame, size: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(rows, points). rows: doc_id, t, fp per row; points: fp, rep (its least doc_id), part (the same for linked fingerprints)."""
    fps = scratch.store(fingerprints(docs, size), "fps")
    points = scratch.store(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    edges = close_pairs(scratch, points.where("rep is not null").select("fp", F.col("fp").alias("rep")), distance)
    parts = connected_components(scratch, edges)
    return fps, scratch.store(points.join(parts, points.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("part")), "parts")


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable by links of at most ``distance`` bits.

    One row per input row. Null or blank texts have fingerprint zero and link like any other. Rows
    stand for themselves: rows of one doc_id with different texts are linked by their fingerprints only, so they may have
    different components. A null doc_id makes no links but takes its fingerprint's
    component. An empty table gives an empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    fps, points = _parts(scratch, docs, size, distance)
    least = points.groupBy("part").agg(F.min("rep").alias("component_id"))
    return fps.join(scratch.store(points.join(least, "part").select("fp", "component_id"), "named"), "fp").select("doc_id", "fp", "component_id")


def simhash_keep(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, that of least doc_id, as do all rows without doc_id.

    Rows of one doc_id stand for themselves: each goes or stays with its own text's component. Null texts count as
    empty, repeated rows stay once, an empty table gives an empty result, further columns pass through.
    """
    scratch = Scratch(docs.sparkSession)
    fps, points = _parts(scratch, docs, size, distance)
    return keep_one(scratch, docs, fps.join(points.select("fp", "part"), "fp").select("doc_id", "t", "part"))


def op2_simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row; see ``simhash_components`` for nulls, blanks and repeated rows."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
