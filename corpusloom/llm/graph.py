"""Connected components of an edge table by randomised contraction.

Each round every node joins its neighbour (or itself) of least hash, edges are renamed to the
chosen representatives and loops vanish. The order is hashed anew each round, so chains and stars
shrink by a constant share in expectation: a logarithmic number of rounds, each a map-side combined
minimum and equi-joins that adaptive execution can split at hubs. Edges never leave the executors.
Once LAST edges or fewer are left, whatever there were at first, one task joins their nodes: a round costs several stages
of as many tasks as shuffles have partitions, all of which the driver keeps account of, and the late rounds have few edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch


#: Edges (16 bytes each) that end the rounds.
LAST = 1 << 18


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the least node reachable: roots are hooked to lesser roots until no edge joins two."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = place[: len(a)], place[len(a) :]
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((further := root[root]) != root).any():
            root = further
    return nodes, nodes[root]


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["node", "rep"])


def connected_components(scratch: Scratch, edges: DataFrame, stored: bool = False) -> DataFrame:
    """edges: a, b (long, no nulls). Returns node, component: the least node reachable, for nodes with an edge."""
    edges = edges if stored else scratch.store(edges, "edges")
    maps: list[DataFrame] = []
    while n := edges.count():
        if n <= LAST:
            maps.append(scratch.store(edges.select("a", "b").coalesce(1).mapInArrow(_last, "node long, rep long"), "chosen"))
            break
        r = len(maps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(r)).alias("h"), F.col("b").alias("n"))).alias("best"))
        own = F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node").alias("n"))
        chosen = scratch.store(best.select("node", F.least("best", own).getField("n").alias("rep")), "chosen")
        left = chosen.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        right = chosen.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        # the first join's result is dealt again by b, so both joins stay splittable at a hub
        renamed = edges.join(left, "a").join(right, "b").where("ra <> rb")
        following = scratch.store(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        edges, maps = following, [*maps, chosen]
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if n and len(maps) == 1:  # one task has named the least nodes
        return maps[0].select("node", F.col("rep").alias("component"))
    labels = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("node").alias("rep"), F.col("rep").alias("after"))
        labels = labels.join(step, "rep", "left").select("node", F.coalesce("after", "rep").alias("rep"))
    if len(maps) > 1:
        labels = scratch.store(labels, "labels")
    least = scratch.store(labels.groupBy("rep").agg(F.min("node").alias("component")), "least")
    return scratch.store(labels.join(least, "rep").select("node", "component"), "components")
