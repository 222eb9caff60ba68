"""Stored indexes against the scans that they stand for."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bm25_index, retrieval, vector_index

WORDS = "rent lease heat mold notice deposit repair court judge tenant landlord window door stair roof a b c d e f g".split()


def hits(rows, value="score"):
    return sorted((r["query_id"], r["rank"], r["id"], round(r[value], 8)) for r in rows.collect())


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(12)
    rows = [(i * 7 - 300, " ".join(r.choice(WORDS[: r.randint(3, len(WORDS))]) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(9001, None), (9002, ""), (9003, "rent " * 50), (9004, "unseen"), (9005, rows[0][1])]
    return spark.createDataFrame(rows, "id long, content string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(13)
    rows = [(i, " ".join(r.choice([*WORDS, "nowhere"]) for _ in range(r.randint(1, 8)))) for i in range(60)]
    rows += [(900, None), (901, "nowhere at all"), (902, "unseen rent rent"), (903, "a")]
    return spark.createDataFrame(rows, "query_id long, content string")


@pytest.mark.parametrize("size", [3, 50, 4096])
def test_bm25_index_equals_scan(texts, asked, tmp_path, size):
    index = bm25_index.build(texts, str(tmp_path / "x"), size=size, buckets=5)
    for k in (1, 5, 40, 500):
        assert hits(bm25_index.search(index, asked, k)) == hits(retrieval.bm25_topk(texts, asked, k))
    again = bm25_index.Bm25Index.load(texts.sparkSession, str(tmp_path / "x"))
    assert (again.n, again.first) == (index.n, index.first) and again.mean == index.mean


def test_more_terms_and_queries_than_a_block(texts, asked, tmp_path, monkeypatch):
    want = hits(retrieval.bm25_topk(texts, asked, 5))
    index = bm25_index.build(texts, str(tmp_path / "x"), size=20, buckets=5)
    monkeypatch.setattr(bm25_index, "FEW", 3)
    monkeypatch.setattr(bm25_index, "QUERIES", 4)
    monkeypatch.setattr(bm25_index, "STEP", 7)
    monkeypatch.setattr(bm25_index, "QUERY_BLOCK", 10)
    monkeypatch.setattr(bm25_index, "EDGES", 2)
    monkeypatch.setattr(bm25_index, "TOKENS", 50)
    assert hits(bm25_index.search(index, asked, 5)) == want
    assert hits(bm25_index.search(bm25_index.build(texts, str(tmp_path / "y"), size=20), asked, 5)) == want


def test_negative_weights_and_unmatched_documents(spark, tmp_path):
    """Terms that nearly all documents hold weigh less than nothing where the mean weight is negative."""
    docs = spark.createDataFrame([(i, "all all more" if i % 5 else "all") for i in range(30)] + [(40, "other")], "id long, content string")
    q = spark.createDataFrame([(1, "all more"), (2, "other all"), (3, "")], "query_id long, content string")
    for size in (4, 100):
        index = bm25_index.build(docs, str(tmp_path / f"x{size}"), size=size)
        for k in (3, 31, 60):
            assert hits(bm25_index.search(index, q, k)) == hits(retrieval.bm25_topk(docs, q, k))


def test_ranges_that_cannot_score_are_skipped():
    weights = np.array([[5.0, 0.0], [0.1, 3.0]])
    scorer = bm25_index._Scorer(weights, 2, 10.0, np.zeros(0, np.int64))
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    rows = lambda ids, tf: pa.RecordBatch.from_arrays([lists(ids, pa.int64()), lists(tf, pa.int32()), lists([[10] * len(x) for x in ids], pa.int32())], ["ids", "counts", "lengths"])
    scorer.take(np.array([0, 1]), np.array([2.2, 2.2]), rows([[1, 2, 3], [1, 2]], [[9, 9, 1], [9, 9]]))
    scorer.take(np.array([1]), np.array([1.0]), rows([[50, 51]], [[1, 1]]))
    assert scorer.skipped == 2 and scorer.scored == 2
    assert len(scorer.best.ids[0]) == 2


def test_a_search_reads_its_buckets_alone(texts, tmp_path, spark):
    index = bm25_index.build(texts, str(tmp_path / "x"), buckets=16)
    q = spark.createDataFrame([(1, "rent")], "query_id long, content string")
    plan = bm25_index.search(index, q, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,rent)" in plan.replace("In(term, [rent])", "EqualTo(term,rent)")
    got = {r["bucket"] for r in index.postings.where("term = 'rent'").select("bucket").distinct().collect()}
    assert got == {bm25_index.bucket_of("rent", 16)}


def test_index_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, content string")
    index = bm25_index.build(docs, str(tmp_path / "x"))
    q = spark.createDataFrame([(1, "rent")], "query_id long, content string")
    assert bm25_index.search(index, q, 5).count() == 0


def test_retrievers_search_stored_indexes(texts, asked, tmp_path, spark):
    vectors = texts.select("id", retrieval.hashed_bag(F.col("content")).alias("embedding"))
    q = asked.where("query_id < 20").withColumn("embedding", retrieval.hashed_bag(F.col("content")))
    chunks = texts.select("id", F.floor(F.col("id") / 21).alias("doc"), F.pmod(F.floor(F.col("id") / 7), F.lit(3)).cast("int").alias("idx"), "content")
    index = bm25_index.build(texts, str(tmp_path / "x"))
    plain = retrieval.Corpus(vectors, texts, chunks)
    stored = retrieval.Corpus(vectors, texts, chunks, lexical=lambda q, k: bm25_index.search(index, q, k))
    for name in ("bm25", "hybrid", "rerank", "hybrid_parent_child"):
        assert hits(retrieval.retrieve(name, stored, q, 4)) == hits(retrieval.retrieve(name, plain, q, 4))


def clustered(n, seed, spread=0.15, width=12):
    centres = np.random.default_rng(0).standard_normal((9, width))
    r = np.random.default_rng(seed)
    return (centres[r.integers(0, 9, n)] + spread * r.standard_normal((n, width))).tolist()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i * 3, v) for i, v in enumerate(clustered(1500, 1))]
    rows += [(10_000 + i, rows[7][1]) for i in range(400)]  # copies
    rows += [(20_000, [0.0] * 12), (20_001, None), (20_002, [1.0, None] * 6), (20_003, [1.0] * 5), (20_004, [float("nan")] + [1.0] * 11), (20_005, [2 * x for x in rows[9][1]]), (None, rows[3][1])]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, v) for i, v in enumerate(clustered(40, 2))] + [(100, [0.0] * 12), (101, None), (102, [1.0] * 5)]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


@pytest.mark.parametrize("lists", [1, 9, 60, None])
def test_vector_index_equals_scan(vectors, points, tmp_path, lists):
    index = vector_index.build(vectors, str(tmp_path / "x"), lists)
    same = vectors.where("id is not null AND size(embedding) = 12")
    asked = points.where("size(embedding) = 12")
    for k in (1, 10, 450):
        assert hits(vector_index.search(index, points, k), "distance") == hits(retrieval.vector_topk(same, asked, k), "distance")
    again = vector_index.VectorIndex.load(vectors.sparkSession, str(tmp_path / "x"))
    assert np.allclose(again.centroids, index.centroids) and np.allclose(again.radius, index.radius)


def test_probes_find_most_neighbours(vectors, points, tmp_path):
    index = vector_index.build(vectors, str(tmp_path / "x"), 40)
    probes = vector_index.probes_for(index, 10, sample=100)
    assert probes < 20
    r = vector_index.recall(index, points.where("query_id < 100"), 10, probes).agg(F.sum("n").alias("n"), F.sum("found").alias("found")).first()
    assert r["n"] == 400 and r["found"] >= 0.95 * r["n"]
    assert vector_index.recall(index, points.where("query_id < 100"), 10, 40).where("found < n").count() == 0


def test_probed_folders_alone_are_read(vectors, points, tmp_path):
    index = vector_index.build(vectors, str(tmp_path / "x"), 60)
    plan = vector_index.search(index, points.where("query_id = 3"), 5, 2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*folder", plan) and "In(list" in plan


def test_vector_index_of_no_vectors(spark, points, tmp_path):
    index = vector_index.build(spark.createDataFrame([], "id long, embedding array<double>"), str(tmp_path / "x"))
    assert vector_index.search(index, points, 3).count() == 0


def test_ragged_vectors_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, None]), (3, [1.0]), (4, None), (5, [0.0, 1.0]), (6, [float("inf"), 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [3.0]), (3, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in retrieval.vector_topk(v, q, 5).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 5), (2, 3)]


def test_forms_of_large_query_ids(spark):
    seen = []

    def base(corpus, q, k):
        seen.append(q)
        return q.select("query_id", (F.col("query_id") * 0).alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    ids = [9007199254740993, -9007199254740993, -5, 0, 3]
    q = spark.createDataFrame([(i, "who pays rent") for i in ids], "query_id long, content string")
    corpus = retrieval.Corpus(q, q, q)
    assert {r["query_id"] for r in retrieval.multiquery(corpus, q, 2, base=base).collect()} == set(ids)


def test_queries_without_terms_close_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, content string")
    q = spark.createDataFrame([(i, "" if i % 2 else "b") for i in range(10)], "query_id long, content string")
    assert retrieval.bm25_topk(docs, q, 2).count() == 20
