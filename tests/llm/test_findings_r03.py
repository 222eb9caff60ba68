"""What the findings of round three on the operators were about."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose, table

from corpusloom.llm import blocks, graph, neardup
from corpusloom.llm.common import Scratch


def _least(edges):
    part = {}
    for a, b in edges:
        one, two = part.setdefault(a, {a}), part.setdefault(b, {b})
        if one is not two:
            one |= two
            part.update(dict.fromkeys(two, one))
    return {n: min(p) for n, p in part.items()}


def _edges():
    r = random.Random(5)
    names = r.sample(range(-10**12, 10**12), 600)
    chain = list(zip(names[:200], names[1:200], strict=False))
    star = [(names[200], n) for n in names[201:400]]
    return chain + star + [(r.choice(names[400:]), r.choice(names[400:])) for _ in range(120)] + [(names[0], names[0])]


@pytest.mark.parametrize("last", [graph.LAST, 150, 0])
def test_components_whatever_ends_the_rounds(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST", last)
    edges = [e for e in _edges() if e[0] != e[1]]
    found = graph.connected_components(Scratch(spark), spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert {r.node: r.component for r in found.collect()} == _least(edges)


def test_joined_chains_stars_and_loops():
    edges = _edges()
    nodes, least = graph.joined(*np.array(edges, np.int64).T)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == _least(edges)


def test_few_edges_take_few_jobs(spark):
    """The driver keeps account of every stage: a chain that shrinks by a half a round took six jobs for each of eight rounds."""
    sc = spark.sparkContext
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    sc.setJobGroup("few edges", "")
    try:
        assert graph.connected_components(Scratch(spark), edges).where("component <> 0").isEmpty()
        assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 12
    finally:
        sc._jsc.clearJobGroup()


def _candidates_of(n):
    """a, b, dense of n near copies of one fingerprint, a seventh of whose bits differ from it."""
    r = np.random.default_rng(n)
    packed = np.packbits(r.integers(0, 2, 1280) ^ (r.random((n, 1280)) < 0.135), axis=1, bitorder="little")
    rows = blocks.bucket_rows(np.arange(n), packed, np.zeros(n, np.uint64), 12, 93).sort_by("bucket")
    zero = pa.array(np.zeros(rows.num_rows, np.int64))
    part = pa.RecordBatch.from_arrays([rows.column(0), zero, zero, zero, *rows.columns[1:]], ["bucket", "i", "j", "own", *rows.schema.names[1:]])
    found = pa.Table.from_batches(list(blocks._candidates(128)(iter([part.slice(at, 1000) for at in range(0, part.num_rows, 1000)]))))
    return [found.column(c).to_numpy() for c in range(3)]


@pytest.mark.parametrize("held", [blocks._HELD, 40])
def test_near_copies_make_pairs_in_proportion(monkeypatch, held):
    """pipeline: buckets of up to 17 copies gave all their pairs, 77 a copy for 250 and 128 a copy for 500, which joins took before most were left out."""
    monkeypatch.setattr(blocks, "_HELD", held)
    for n in (250, 500):
        a, b, dense = _candidates_of(n)
        assert len(np.unique(np.stack([a, b])[:, ~dense], axis=1).T) <= 15 * n
        nodes, least = graph.joined(a[dense], b[dense])
        assert len(nodes) == n and not least.any()  # every copy is in the one group, which is compared all by all
        if held > 1000:
            assert dense.sum() == n - 1


def test_groups_larger_than_a_block_of_fingerprints(spark, monkeypatch):
    """Copies with up to six words of 120 replaced: close by sketch, partly similar, in groups of more than one block."""
    r, rows = random.Random(8), []
    for i in range(3):
        base = prose(8000 + i, 120).split()
        for _ in range(60):
            words = list(base)
            for at in r.sample(range(120), r.choice([1, 2, 3, 6])):
                words[at] = f"new{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    whole = {x.doc_id: x.component_id for x in neardup.near_components(table(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "PRINTS", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    parted = {x.doc_id: x.component_id for x in neardup.near_components(table(spark, rows)).collect()}
    sets = [set(neardup.shingle_set(t.encode()).tolist()) for _, t in rows]
    edges = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert whole == parted == {i: i for i in range(len(rows))} | _least(edges)
