"""Candidates from buckets of sketches, shared by the near-duplicate operators.

An entry is a point's place in one bucket: bucket, i, j, own (its block), node and the words of a sketch. Pairs of a bucket whose
sketches differ in few bits are candidates. Points of a bucket that these connect, with more pairs than points, are close to one another,
and pairs are not made: the candidates' spanning forest puts the points together. So no bucket gives more rows than it has points, however
many of these are near copies. Buckets of more than CROWD entries are dealt out as blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, trim
from corpusloom.llm.graph import joined
from corpusloom.llm.textkernel import mix

#: Bits of a sketch (whole numbers of 64), entries of a crowded bucket, candidates a point beyond which pairs are not made, rows compared at a time,
#: edges of forests that a task holds.
SKETCH, CROWD, DENSE, _ROWS, _HELD = 128, 2048, 1, 256, 1 << 16
SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]


def binomial_bound(n: int, p: float, miss: float) -> int:
    """The least number of n events of chance p each that is exceeded with a chance of at most ``miss``."""
    below = 0.0
    for k in range(n + 1):
        below += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if 1 - below <= miss:
            return k
    return n


def tables_for(bits: int, apart: float, miss: float) -> int:
    """Tables of that many bits in none of which a pair agrees with a chance of at most ``miss``, if a bit differs with chance ``apart``."""
    return math.ceil(math.log(miss) / math.log1p(-((1 - apart) ** bits)))


def codes(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Of packed bits, a row a point, that follow a sketch: the numbers of ``bits`` bits each, by table."""
    own = np.unpackbits(packed, axis=1, bitorder="little")[:, SKETCH : SKETCH + bits * tables].reshape(len(packed), tables, bits)
    return (own.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def bucket_rows(node: np.ndarray, packed: np.ndarray, kind: np.ndarray, bits: int, tables: int) -> pa.RecordBatch:
    """bucket (one number for kind, table and code), node and sketch: the points' places in all tables."""
    bucket = mix(mix(kind)[:, None] + mix(np.arange(1, tables + 1, dtype=np.uint64))[None, :]) ^ codes(packed, bits, tables) * np.uint64(0x9E3779B97F4A7C15)
    sketch = np.repeat(packed[:, : SKETCH // 8].copy().view(np.int64), tables, axis=0)
    columns = [mix(bucket).ravel().view(np.int64), np.repeat(node, tables), *sketch.T]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["bucket", "node", *SKETCHES])


BUCKET_ROWS = "bucket long, node long, " + ", ".join(f"{s} long" for s in SKETCHES)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def close(sketch: np.ndarray, bound: int, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches differ in at most ``bound`` signs: all, or those from before ``cut`` with those after."""
    found = []
    last = len(sketch) if cut is None else cut
    for lo in range(0, last, _ROWS):
        part = sketch[lo : min(lo + _ROWS, last)]
        others = sketch[cut:] if cut is not None else sketch[lo + 1 :]
        apart = sum(np.bitwise_count(part[:, None, c] ^ others[None, :, c]).astype(np.uint16) for c in range(sketch.shape[1]))
        a, b = np.nonzero(apart <= bound)
        if cut is None:
            a, b = a[b >= a], b[b >= a]
        found.append((a + lo, b + (cut if cut is not None else lo + 1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2  # type: ignore[return-value]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows that agree in the first ``keys`` columns."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        columns = [whole.column(k).to_numpy() for k in range(keys)]
        bounds = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns], axis=0)) + 1).tolist()]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield whole.slice(lo, hi - lo)
        held = whole.slice(bounds[-1])
    if held is not None:
        yield held
    trim()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least node of each component to its others."""
    nodes, least = joined(a, b)
    return least[nodes != least], nodes[nodes != least]


def _candidates(bound: int):
    """Pairs a, b of a bucket's close sketches; of points with more than DENSE pairs each, the spanning forest over a task's buckets, marked dense."""

    def found(a: np.ndarray, b: np.ndarray, dense: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), dense))], ["a", "b", "dense"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in runs(batches, 3):
            if part.num_rows < 2:
                continue
            block, node = part.column(3).to_numpy(), part.column(4).to_numpy()
            sketch = np.stack([part.column(c).to_numpy() for c in range(5, 5 + len(SKETCHES))], 1).view(np.uint64)
            cut = None
            if part.column(1)[0] != part.column(2)[0]:
                order = np.argsort(block, kind="stable")
                block, node, sketch = block[order], node[order], sketch[order]
                cut = int(np.searchsorted(block, block[0], side="right"))
            a, b = close(sketch, bound, cut)
            if not len(a):
                continue
            root = roots(len(node), a, b)
            dense = (np.bincount(root[a], minlength=len(node)) > DENSE * np.bincount(root, minlength=len(node)))[root]
            few = ~dense[a]
            if few.any():
                yield found(node[a[few]], node[b[few]], False)
            others = np.flatnonzero(dense & (root != np.arange(len(root))))
            if len(others):
                held.append((node[root[others]], node[others]))
                size += len(others)
            if size > _HELD:
                held = [_forest(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield found(*held.pop(), True)
                    size = 0
        if held:
            yield found(*_forest(*(np.concatenate(c) for c in zip(*held, strict=True))), True)

    return run


def dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows (a key, node, ``blocks``: how many blocks the key has) once for each pair of blocks i, j that their own block is in."""
    spread = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def candidates(scratch: Scratch, entries: DataFrame, bound: int) -> DataFrame:
    """a, b, dense (stored, distinct): of entries (``BUCKET_ROWS``), the pairs whose sketches differ in at most ``bound`` bits, or what connects them."""
    crowds = scratch.store(entries.groupBy("bucket").agg(F.count("*").alias("s")).where(F.col("s") > CROWD).select("bucket", F.ceil(F.col("s") / CROWD).cast("int").alias("nb")), "crowds")
    if crowds.isEmpty():
        entries = entries.withColumns({c: F.lit(0) for c in ("i", "j", "own")})
    else:
        entries = dealt(entries.join(crowds, "bucket", "left").withColumn("nb", F.coalesce("nb", F.lit(1))), "nb")
    entries = entries.select("bucket", "i", "j", "own", "node", *SKETCHES)
    near = entries.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_candidates(bound), "a long, b long, dense boolean")
    return scratch.store(near.distinct(), "candidates")
