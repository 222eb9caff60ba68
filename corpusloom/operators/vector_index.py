"""A stored index for vector search: coarse lists, codes of residuals, exact cosines at the end.

Vectors are scaled to length one, so that the least cosine distance is the least Euclidean one. Centroids come from k-means over a bounded sample; every
vector lies in the list of its nearest centroid, as the eight-bit code of what is left, with the length of the code's error. Lists are folders of
Parquet (LISTS_IN_FOLDER lists each), so a search reads the folders of the lists that it probes.

A member of a list is no nearer to a query than the query's distance to the centroid less the list's radius, and no nearer than its code
says less the code's error. ``search`` with ``probes`` looks at that many nearest lists of each query; without, it goes on to every list
that these bounds cannot rule out, and the result is that of ``vector_topk``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import QUERY_BLOCK, _unit, numbers, ranked

#: Vectors that centroids are fitted on, most lists, vectors that a list should have, rounds of k-means, lists of a folder, bytes of a row group.
SAMPLE, LISTS, MEMBERS, ROUNDS, LISTS_IN_FOLDER, ROW_GROUP = 1 << 17, 1 << 14, 256, 12, 16, 4 << 20
#: Lists that an exact search probes first, members whose neighbours tell how many lists a search needs.
FIRST, TUNED = 8, 256
#: Numbers that the sample has at most (64 MB).
CELLS = 1 << 23
#: What rounding in double precision can do to a distance of unit vectors.
_SLACK = 1e-7
CODES = "list int, id long, code binary, scale double, error double, embedding array<double>, folder int"


@dataclass
class VectorIndex:
    """An index at ``path``: its centroids and the radius of each list, by list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray

    @property
    def members(self) -> DataFrame:
        """list, id, code, scale, error, embedding, folder."""
        return self.spark.read.schema(CODES).parquet(f"{self.path}/members")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])  # at most LISTS
        return cls(spark, path, np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1), np.array([r["radius"] for r in rows], np.float64))


def kmeans(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """n centroids of vectors of length one, themselves scaled to one; a list that loses all its vectors takes one at random."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = nearest_of(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        lost = np.bincount(own, minlength=n) == 0
        sums[lost] = x[r.choice(len(x), int(lost.sum()))]
        c = _unit(sums)
    return c


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def encoded(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of residuals, their scale and the length of their error."""
    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
    code = np.rint(rest / scale[:, None])
    return code.astype(np.int8), scale, np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1))


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of vectors (id, embedding) to ``path``, which must not exist, and return it.

    Vectors that are null, or hold null or non-finite numbers, or have not the length that most have, are left out; zero vectors stay, at distance
    1 of all. Centroids are fitted on the ``sample`` vectors whose ids have the least hashes (CELLS numbers at most); ``lists`` is a list for MEMBERS vectors unless given, LISTS at most.
    """
    spark = vectors.sparkSession
    rows = vectors.where("id is not null AND embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    size, total = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    sample = max(1, min(sample, CELLS // size))
    share = min(1.0, 1.2 * sample / max(1, total))
    cut = int(share * 2**63) - 2**62 if share < 1 else None  # a few more than are asked for
    some = rows if cut is None else rows.where(F.shiftright(F.xxhash64("id"), 1) < cut)
    drawn = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column(0)
    drawn = drawn.combine_chunks() if len(drawn) else pa.array([], pa.list_(pa.float64()))
    x = _unit(numbers(drawn, size)[0])
    n = max(1, min(lists or math.ceil(total / MEMBERS), LISTS, len(x)))
    held = spark.sparkContext.broadcast(kmeans(x, n) if len(x) else np.zeros((1, size)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            lists_ = pa.concat_arrays([batch.column(1)])
            x, rows_ = numbers(lists_, c.shape[1])
            unit = _unit(x)
            own = nearest_of(unit, c)
            code, scale, error = encoded(unit - c[own])
            columns = [pa.array(own.astype(np.int32)), batch.column(0).take(pa.array(rows_)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), pa.array(error), lists_.take(pa.array(rows_)), pa.array((own // LISTS_IN_FOLDER).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [c_.split()[0] for c_ in CODES.split(", ")])

    coded = rows.mapInArrow(assigned, CODES)
    spread = coded.repartitionByRange("folder", "list", "id").sortWithinPartitions("folder", "list", "id")  # a list of many equal vectors goes to several tasks
    spread.write.partitionBy("folder").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/members")

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, most = held.value, np.full(len(held.value), -1.0)
        for batch in batches:
            own = batch.column(0).to_numpy()
            x, rows_ = numbers(pa.concat_arrays([batch.column(1)]), c.shape[1])
            np.maximum.at(most, own[rows_], np.sqrt(((_unit(x) - c[own[rows_]]) ** 2).sum(axis=1)))
        met = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(most[met])], ["list", "radius"])

    members = spark.read.schema(CODES).parquet(f"{path}/members")
    radius = np.zeros(len(held.value))
    for r in members.select("list", "embedding").mapInArrow(far, "list int, radius double").groupBy("list").agg(F.max("radius").alias("radius")).collect():  # at most LISTS rows
        radius[r["list"]] = r["radius"]
    lists_ = [(i, c.tolist(), float(d)) for i, (c, d) in enumerate(zip(held.value, radius, strict=True))]
    spark.createDataFrame(lists_, "list int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{path}/lists")
    return VectorIndex(spark, path, held.value, radius)


def _away(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T, 0))


class _Probe:
    """Queries of a block, the lists that each probes, and its k best so far."""

    def __init__(self, x: np.ndarray, k: int, probed: np.ndarray, most: np.ndarray):
        self.x, self.k, self.probed, self.most = x, k, probed, most
        self.values, self.ids = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)

    def take(self, at: int, centroid: np.ndarray, ids: np.ndarray, code: np.ndarray, scale: np.ndarray, error: np.ndarray, lists: pa.Array) -> None:
        asked = np.flatnonzero(self.probed[:, at])
        if not len(asked):
            return
        about = centroid + code * scale[:, None]
        d2 = np.maximum((self.x[asked] ** 2).sum(axis=1)[:, None] + (about**2).sum(axis=1)[None, :] - 2 * self.x[asked] @ about.T, 0)
        least = np.sqrt(d2) - error[None, :] - _SLACK  # no member is nearer than this
        # a cosine distance is half the square of the distance of unit vectors
        bound = np.sqrt(2 * np.maximum(np.minimum(self.values[asked, -1], self.most[asked]), 0)) + _SLACK
        near = least <= bound[:, None]
        rows = np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        x, _ = numbers(lists.take(pa.array(rows)), self.x.shape[1])
        exact = np.where(near[:, rows], 1 - self.x[asked] @ _unit(x).T, np.inf)
        v, i = np.concatenate([self.values[asked], exact], axis=1), np.concatenate([self.ids[asked], np.broadcast_to(ids[rows], exact.shape)], axis=1)
        order = np.lexsort((i, np.round(v, 9)), axis=1)[:, : self.k]
        self.values[asked], self.ids[asked] = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)


def _scanned(index: VectorIndex, ids: np.ndarray, x: np.ndarray, k: int, probed: np.ndarray, most: np.ndarray) -> DataFrame:
    """The k best of each query in the lists it probes; folders that none probes are not read."""
    lists = np.flatnonzero(probed.any(axis=0))
    held = index.spark.sparkContext.broadcast((ids, x, probed, most, index.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, probed, most, centroids = held.value
        probe = _Probe(x, k, probed, most)
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi and probed[:, own[lo]].any():
                    part = batch.slice(lo, hi - lo)
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(hi - lo, -1)
                    probe.take(own[lo], centroids[own[lo]], *[part.column(i).to_numpy() if i != 2 else code for i in (1, 2, 3, 4)], pa.concat_arrays([part.column(5)]))
        good = np.isfinite(probe.values)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(axis=1))), pa.array(probe.ids[good]), pa.array(probe.values[good])], ["query_id", "id", "distance"])

    rows = index.members.where(F.col("folder").isin(sorted({int(i) // LISTS_IN_FOLDER for i in lists})))
    if len(lists) <= 1000:
        rows = rows.where(F.col("list").isin(lists.tolist()))
    return rows.select("list", "id", "code", "scale", "error", "embedding").mapInArrow(run, "query_id long, id long, distance double")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, id, distance (1 - cosine, least first), rank of the k nearest. queries: query_id, embedding.

    With ``probes``, of the members of that many lists whose centroids are nearest; without, of all, as ``vector_topk`` gives them: lists are probed in two rounds, the
    second for those that the bounds of the first leave. Queries go out in blocks of QUERY_BLOCK; null queries and such of another length find nothing.
    """
    spark, out = index.spark, []

    def asked(block: list) -> DataFrame:
        q, good = numbers(pa.array([r["embedding"] for r in block], pa.list_(pa.float64())), index.centroids.shape[1])
        ids, x = np.array([r["query_id"] for r in block], np.int64)[good], _unit(q)
        away = _away(x, index.centroids)
        order = np.argsort(away, axis=1)[:, : probes or FIRST]
        probed = np.zeros(away.shape, bool)
        np.put_along_axis(probed, order, True, axis=1)
        first = _scanned(index, ids, x, k, probed, np.full(len(x), np.inf))
        if probes:
            return first
        first = first.persist(StorageLevel.DISK_ONLY)  # k rows a query and task
        kth = {r["query_id"]: r["distance"] for r in ranked(first, k, F.round("distance", 9), F.col("id")).where(F.col("rank") == k).select("query_id", "distance").collect()}  # a row a query of the block
        most = np.array([kth.get(int(i), np.inf) for i in ids])
        reach = np.sqrt(2 * np.maximum(most, 0)) + _SLACK
        rest = ~probed & ((away - index.radius[None, :] <= reach[:, None] + _SLACK) | ~np.isfinite(most)[:, None] | (x == 0).all(axis=1)[:, None])
        return first.unionByName(_scanned(index, ids, x, k, rest, most + 2e-9)) if rest.any() else first

    block: list = []
    for r in queries.where("embedding is not null").select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out.append(asked(block))
            block = []
    if block or not out:
        out.append(asked(block))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return ranked(found, k, F.round("distance", 9), F.col("id"))




def probes_for(index: VectorIndex, k: int, share: float = 0.97, sample: int = TUNED) -> int:
    """The lists that a search must probe so that it finds ``share`` of the k nearest: measured on the ``sample`` members whose ids have the least hashes, against their exact search."""
    drawn = index.members.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding").persist(StorageLevel.DISK_ONLY)
    true = search(index, drawn, k).select("query_id", "id").join(index.members.select("id", "list"), "id").select("query_id", "list").collect()  # k rows for each of the sample
    rows = {r["query_id"]: r["embedding"] for r in drawn.collect()}
    drawn.unpersist()
    if not true:
        return 1
    x = _unit(np.array(list(rows.values()), np.float64))
    place = np.argsort(np.argsort(_away(x, index.centroids), axis=1, kind="stable"), axis=1)
    at = {q: i for i, q in enumerate(rows)}
    needed = np.sort([place[at[r["query_id"]], r["list"]] for r in true])
    return int(needed[min(len(needed) - 1, math.ceil(share * len(needed)) - 1)]) + 1


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, n, found: of each query's k nearest vectors how many there are and how many a search of ``probes`` lists finds."""
    exact = search(index, queries, k).select("query_id", "id")
    near = search(index, queries, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
