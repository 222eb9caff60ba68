"""Nearest neighbours of a set of queries among all vectors, by a block matrix join.

Queries and candidates are dealt to cells, one for each part of the queries and part of the candidates. A cell holds its queries and takes its candidates in tiles.
Vectors are rounded to int8 with a scale each; a tile's products are whole numbers below 2**24, so a matrix product of
floats gives them exactly. They give the distance of the rounded vectors, from which the true one differs by at most the two rounding errors,
whose lengths are known. A pair whose least possible distance is beyond the query's k-th so far is
done with; the others' distances are computed from the original numbers in double precision, and go into the query's heap. Cells' heaps are merged at the end.
So the result is exact.

Equal vectors of an Arrow batch are one candidate with its least ids, as no more of them than a heap holds can count;
equal queries are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.llm.common import Scratch, trim

NEAREST, ASKED = 10, 100
#: Queries of a cell, most candidates of a cell, candidates of a tile, queries of a tile, components whose products a float holds, pairs recomputed at a time.
QUERIES, CANDIDATES, TILE, ROWS, WIDTH, PAIRS = 1 << 14, 1 << 20, 4096, 1024, 1024, 1 << 15
#: Times the lengths of two vectors, what rounding in double precision can do to the distance of their rounded forms.
_SLACK = 1e-7


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scale and length of the rounding error of each vector."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
    q = np.rint(x / scale[:, None])
    rest = x / scale[:, None] - q  # scaled, so that squares stay within range
    return q.astype(np.int8), scale, scale * np.sqrt((rest * rest).sum(axis=1))


def squares(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared lengths of rounded vectors, infinite where they are out of range."""
    with np.errstate(over="ignore"):
        return (q.astype(np.float64) ** 2).sum(axis=1) * scale**2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 vectors: |a b| < 2**24 over WIDTH components."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], WIDTH):
        out += a[:, i : i + WIDTH].astype(np.float32) @ b[:, i : i + WIDTH].astype(np.float32).T
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision, squares added up from left to right."""
    d = x - y
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


class Heaps:
    """The k nearest candidates of each query so far, of equals those of least id: distances, least ids and numbers, rows in order."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.x, self.k = vectors, k
        self.q, self.scale, self.error = rounded(vectors)
        self.square = squares(self.q, self.scale)
        self.d = np.full((len(vectors), k), np.inf)
        self.id = np.full((len(vectors), k), np.iinfo(np.int64).max)
        self.node = np.full((len(vectors), k), -1)
        self.recomputed = 0

    def take(self, vectors: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> None:
        q, scale, error = rounded(vectors)
        square = squares(q, scale)
        for at in range(0, len(self.x), ROWS):
            own = slice(at, at + ROWS)
            with np.errstate(over="ignore", invalid="ignore"):
                about = np.sqrt(np.maximum(self.square[own, None] + square[None, :] - 2 * self.scale[own, None] * scale[None, :] * products(self.q[own], q), 0))
                slack = self.error[own, None] + error[None, :] + _SLACK * (np.sqrt(self.square[own])[:, None] + np.sqrt(square)[None, :])
                most = self.d[own, -1]
                if len(vectors) >= self.k and np.isinf(most).any():  # k candidates are no farther than this, so no heap needs what is
                    most = np.minimum(most, np.partition(about + slack, self.k - 1, axis=1)[:, self.k - 1])
                near = ~(about - slack > most[:, None])  # what cannot be told is near
            a, b = np.nonzero(near)
            cuts = np.searchsorted(a, np.arange(0, ROWS, max(1, PAIRS // max(1, len(vectors)))))  # whole queries at a time
            for i, j in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
                if j > i:
                    self._merge(a[i:j] + at, b[i:j], vectors, ids, nodes)

    def _merge(self, a: np.ndarray, b: np.ndarray, vectors: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> None:
        self.recomputed += len(a)
        d = np.concatenate([distances(self.x[a[i : i + PAIRS]], vectors[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)])
        asked = np.unique(a)
        query = np.concatenate([np.repeat(asked, self.k), a])
        d, own, node = (np.concatenate([x[asked].ravel(), y]) for x, y in ((self.d, d), (self.id, ids[b]), (self.node, nodes[b])))
        order = np.lexsort((node, own, d, query))
        first = np.searchsorted(query[order], asked)
        kept = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]
        for held, x in ((self.d, d), (self.id, own), (self.node, node)):
            held[asked] = x[kept].reshape(-1, self.k)

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        found = self.node >= 0
        n = found.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(self.node[found]), pa.array(self.id[found]), pa.array(self.d[found])], ["query", "node", "id", "score"])


def _candidates(k: int, asked: int, kind: str):
    """vec, h1, h2, size, id, ids (at most k + 1, ascending), asks of each distinct vector of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, set[int]] = {}
            for i, x in zip(batch.column(0).to_pylist(), usable(batch.column(1), kind), strict=True):
                if i is not None and x is not None:
                    ids.setdefault(x, set()).add(i)
            lists = [sorted(x) for x in ids.values()]
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(x), ">i8") for x in ids], np.int64).reshape(-1, 2)
            asks = [[i for i in x if i % asked == 0] for x in lists]
            least = [x[: k + 1] for x in lists]
            columns = [pa.array(list(ids), pa.binary()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([len(x) for x in ids], pa.int32()), pa.array([x[0] for x in lists], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (least, asks)]]
            yield pa.RecordBatch.from_arrays(columns, ["vec", "h1", "h2", "size", "id", "ids", "asks"])

    return run


def usable(column: pa.Array, kind: str) -> Iterator[bytes | None]:
    """The numbers of each list as bytes; None for lists that are null, empty or zero, or hold null or non-finite numbers."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # a null number becomes NaN
    for i, there in enumerate(column.is_valid().to_pylist()):
        x = flat[offsets[i] : offsets[i + 1]].astype(kind) + 0.0  # -0.0 becomes 0.0
        yield x.astype(kind).tobytes() if there and np.isfinite(x).all() and x.any() else None


def _searched(k: int, kind: str):
    """Heaps of cells: rows size, q, c, side, node, id, vec sorted by cell and side, queries (side 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heaps, queries, vectors, tile = None, None, [], [], []

        def matrix(vecs: list[bytes]) -> np.ndarray:
            return np.frombuffer(b"".join(vecs), kind).astype(np.float64).reshape(len(vecs), -1)

        def scanned() -> None:
            nonlocal heaps
            if tile and queries:
                heaps = heaps or Heaps(matrix(vectors), k)
                nodes, ids = (np.concatenate([x.column(i).to_numpy() for x in tile]) for i in (4, 5))
                heaps.take(matrix([v for x in tile for v in x.column(6).to_pylist()]), ids, nodes)
            tile.clear()

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(4)]
            bounds = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo == hi:
                    continue
                part, at = batch.slice(lo, hi - lo), tuple(int(x[lo]) for x in keys[:3])
                if at != cell:
                    scanned()
                    if heaps is not None:
                        yield heaps.batch(np.array(queries, np.int64))
                    cell, heaps, queries, vectors = at, None, [], []
                if keys[3][lo] == 0:
                    queries += part.column(4).to_pylist()
                    vectors += part.column(6).to_pylist()
                else:
                    for i in range(0, part.num_rows, TILE):
                        tile.append(part.slice(i, TILE))
                        if sum(x.num_rows for x in tile) >= TILE:
                            scanned()
        scanned()
        if heaps is not None:
            yield heaps.batch(np.array(queries, np.int64))
        trim()

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, asked: int = ASKED, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other vectors of each row of vectors (vec_id, embedding) whose vec_id is divisible by ``asked``.

    Nearness is Euclidean distance in double precision, of equals the least vec_id comes first; fewer candidates than k are all returned; distances beyond the range of doubles are infinite, and tie. Vectors that are
    null, empty or zero or hold null or non-finite numbers take no part, nor do rows without vec_id; vectors of different lengths have no distance.
    Rows that repeat a vec_id: equal ones count once, different ones are candidates of their own, but never of a query of the same vec_id, which then gets the nearest to any of
    its vectors, each of which ranks its own. An empty table gives an empty result; further columns are ignored. Cells hold at most about ``queries`` queries and ``candidates`` candidates.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    number, kind = ("float", "<f4") if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    found = rows.mapInArrow(_candidates(k, asked, kind), "vec binary, h1 long, h2 long, size int, id long, ids array<long>, asks array<long>")
    points = scratch.store(found.withColumn("node", F.monotonically_increasing_id()), "points")  # numbers are as stored from here on
    asking = points.where("size(asks) > 0")
    asks = scratch.store(asking.groupBy("h1", "h2", "size").agg(F.min("node").alias("node"), F.min("vec").alias("vec")), "queries")

    parts = max(1, -(-asks.count() // queries))
    n = points.count()
    pieces = max(1, -(-n // candidates), min(spark.sparkContext.defaultParallelism * 2, -(-n // TILE)))
    part = lambda m, of: F.pmod(F.xxhash64(of), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asks.select("size", part(parts, "node").alias("q"), every(pieces).alias("c"), F.lit(0).alias("side"), "node", F.lit(0).cast("long").alias("id"), "vec")
    right = points.select("size", every(parts).alias("q"), part(pieces, "node").alias("c"), F.lit(1).alias("side"), "node", "id", "vec")
    dealt = left.unionByName(right).repartition(parts * pieces, "size", "q", "c").sortWithinPartitions("size", "q", "c", "side")
    heaps = dealt.mapInArrow(_searched(k + 1, kind), "query long, node long, id long, score double")
    best = lambda rows, m, by, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= m)
    near = scratch.store(best(heaps, k + 1, "query", "score", "id", "node"), "nearest").drop("rank")

    copies = points.where("size(ids) > 1").select("node", "ids")
    ids = near.join(copies, "node", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id")).distinct()
    first = best(ids, k + 1, "query", "score", "vec_id").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    named = asks.select("h1", "h2", "size", F.col("node").alias("query")).join(first, "query")
    each = asking.select("h1", "h2", "size", F.explode("asks").alias("query_id")).join(named, ["h1", "h2", "size"]).distinct()
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op12_nearest_neighbours(vectors: DataFrame) -> DataFrame:
    """``nearest`` of the rows whose vec_id is divisible by 100: query_id, rank, vec_id, score; see there for nulls, ties and repeats."""
    return nearest(vectors)


_ALL = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_ALL}),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v c ON q.vec_id % {ASKED} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM d WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= {NEAREST}"""
