"""Ranked retrieval for batches of queries.

Results are (query_id, id, score, rank); rank starts at 1 and is explicit, as rows have no order.
Vectors are scored against blocks of queries by matrix products in Arrow batches, each task
sending at most k rows a query on; so does BM25 with term weights; fusion, reranking
and expansion work on the few rows per query that these leave.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS, containment, tokens
from corpusloom.operators.serving import DIMENSIONS, bags, hashed_bag, signed_buckets

#: Queries that one pass over the vectors scores; more take more passes.
QUERY_BLOCK = 1024
#: Cells of the matrix of query terms and queries, documents scored together, and cells of their terms' gains at a time.
QUERY_CELLS, DOC_BLOCK, GAIN_CELLS = 1 << 21, 1024, 1 << 21
K1, B, EPSILON = 1.5, 0.75, 0.25


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The k least values of each query, of equals the least ids, over blocks of candidates."""

    def __init__(self, queries: int, k: int):
        self.k, self.values, self.ids = k, np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        if self.values.shape[1] == self.k and len(values):  # of columns that are beyond every query's k-th nothing is needed
            near = (values <= self.values[:, -1:] + 1e-9).any(axis=0)
            if not near.any():
                return
            values, ids = values[:, near], ids[near]
        v = np.concatenate([self.values, values], axis=1)
        i = np.concatenate([self.ids, np.broadcast_to(ids, values.shape)], axis=1)
        if v.shape[1] > 4 * self.k:  # no row beyond the k-th value can be among the k first
            cut = np.partition(v, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = max(self.k, int((v <= cut + 1e-9).sum(axis=1).max())) if len(v) else self.k
            part = np.argpartition(v, min(width, v.shape[1]) - 1, axis=1)[:, :width]
            v, i = np.take_along_axis(v, part, 1), np.take_along_axis(i, part, 1)
        order = np.lexsort((i, np.round(v, 9)), axis=1)[:, : self.k]
        self.values, self.ids = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)

    def batch(self, queries: np.ndarray, name: str, sign: float) -> pa.RecordBatch:
        n = self.values.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(self.ids.ravel()), pa.array(sign * self.values.ravel() + 0.0)], ["query_id", "id", name])


def numbers(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors of ``size`` finite numbers, none of them null, and which of the lists these are."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    right = np.flatnonzero((np.diff(offsets) == size) & lists.is_valid().to_numpy(zero_copy_only=False))
    x = values[offsets[right][:, None] + np.arange(size)[None, :]]
    good = np.isfinite(x).all(axis=1)
    return x[good], right[good]


def bag_numbers(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``numbers`` of vectors that come as signed buckets."""
    return bags(lists), np.arange(len(lists))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, bagged: bool = False) -> DataFrame:
    """query_id, id, distance (1 - cosine, least first), rank. vectors: id, embedding; queries: query_id, embedding.

    A query is compared with the vectors of its length; vectors that are null or hold null or non-finite numbers take no part. ``bagged``: embeddings are
    ``signed_buckets``. The queries' count is checked: they go out in blocks of QUERY_BLOCK, so memory stays bounded
    whatever their number, and every vector is compared.
    """
    spark = vectors.sparkSession
    read = bag_numbers if bagged else numbers
    out: DataFrame | None = None

    def scored(ids: list[int], vecs: list[list[float]], size: int) -> DataFrame:
        kind = pa.list_(pa.int32() if bagged else pa.float64())
        q, good = read(pa.array(vecs, kind), size)
        held = spark.sparkContext.broadcast((np.array(ids, np.int64)[good], _unit(q)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best = _Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, DOC_BLOCK):
                    b = batch.slice(at, DOC_BLOCK)
                    x, rows = read(pa.concat_arrays([b.column(1)]), size)
                    if len(x):
                        best.add(1 - q @ _unit(x).T, b.column(0).to_numpy()[rows])
            yield best.batch(ids, "distance", 1.0)

        return vectors.select("id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, id long, distance double")

    blocks: dict[int, tuple[list[int], list[list[float]]]] = {}
    for r in queries.where("embedding is not null").select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        size = DIMENSIONS if bagged else len(r["embedding"])
        ids, vecs = blocks.setdefault(size, ([], []))
        ids.append(r["query_id"])
        vecs.append(r["embedding"])
        if sum(len(x) for x, _ in blocks.values()) == QUERY_BLOCK:
            for n in list(blocks):
                part = scored(*blocks.pop(n), n)
                out = part if out is None else out.unionAll(part)
    for size, (ids, vecs) in (blocks or ({} if out is not None else {1: ([], [])})).items():
        part = scored(ids, vecs, size)
        out = part if out is None else out.unionAll(part)
    return ranked(out, k, F.round("distance", 9), F.col("id"))


Terms = Callable[[Column], Column]


@dataclass
class Statistics:
    """What BM25 knows of a corpus: documents, their mean length, the mean weight of its terms, and term, df (documents that hold it).

    Counted once, by ``statistics``, and good for any number of searches of the same texts with the same ``terms``.
    """

    n: int
    mean: float
    mean_weight: float
    table: DataFrame

    def weights(self, vocabulary: set[str]) -> dict[str, float]:
        """Weights of those of the terms that the corpus has; the caller bounds the vocabulary. A negative weight becomes EPSILON times the mean weight."""
        asked = self.table.sparkSession.createDataFrame([(t,) for t in sorted(vocabulary)], "term string")
        found = self.table.join(F.broadcast(asked), "term").select("term", _weight(F.lit(self.n)).alias("w")).collect()
        return {r["term"]: r["w"] if r["w"] >= 0 else EPSILON * self.mean_weight for r in found}

    def release(self) -> None:
        self.table.unpersist()


def _weight(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def statistics(docs: DataFrame, terms: Terms = tokens) -> Statistics:
    """One scan and one shuffle of distinct terms, combined on the map side. docs: id, content. Spark may evict the table, which ``release`` frees."""
    words = docs.select(terms(F.coalesce("content", F.lit(""))).alias("terms"))
    # the empty term stands in every document: its row counts them and adds up their lengths
    each = words.select(F.size("terms").cast("long").alias("length"), F.explode(F.array_append(F.array_distinct("terms"), F.lit(""))).alias("term"))
    counted = each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("length")).persist(StorageLevel.DISK_ONLY)
    whole = counted.where("term = ''").first()
    n, length = (whole["df"], whole["length"]) if whole else (0, 0)
    table = counted.where("term <> ''").select("term", "df")
    mean_weight = table.agg(F.avg(_weight(F.lit(n))).alias("m")).first()["m"]
    found = Statistics(n, (length / n if n else 0) or 1.0, mean_weight or 0.0, table)
    found.release = counted.unpersist  # type: ignore[method-assign]
    return found


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, terms: Terms = tokens, known: Statistics | None = None) -> DataFrame:
    """query_id, id, score, rank with Okapi weights; documents without a match score 0 and follow in order of id.

    docs: id, content; queries: query_id, content. ``terms`` makes terms of texts (``stemmed_tokens`` stems them); ``known`` are the
    statistics of docs where they have been counted. Repeated query terms count each time. Documents are scanned once more, where
    they lie: each Arrow batch is a sparse matrix of
    term gains times the queries' matrix of weights, and each task sends on at most k rows a query, so no postings are
    shuffled. Queries go out in blocks of at most QUERY_BLOCK whose matrix has at most QUERY_CELLS cells, and weights are asked for block by block.
    """
    spark = docs.sparkSession
    asked = queries.select("query_id", terms(F.coalesce("content", F.lit(""))).alias("terms"))
    stats = known or statistics(docs, terms)
    mean = stats.mean
    words = docs.select("id", terms(F.coalesce("content", F.lit(""))).alias("terms"))

    def scored(block: list[tuple[int, Counter]], vocabulary: set[str]) -> DataFrame:
        weights = stats.weights(vocabulary) if vocabulary else {}
        names = sorted(weights)
        place = {t: i for i, t in enumerate(names)}
        matrix = np.zeros((len(names), len(block)))
        for j, (_, c) in enumerate(block):
            for t, n in c.items():
                if t in place:
                    matrix[place[t], j] = n * weights[t]
        held = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, matrix = held.value
            value_set = pa.array(names, pa.string())
            best = _Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, DOC_BLOCK):
                    b = batch.slice(at, DOC_BLOCK)
                    sizes = np.diff(b.column(1).offsets.to_numpy())
                    found = pc.fill_null(pc.index_in(b.column(1).flatten(), value_set=value_set), -1).to_numpy()
                    owner = np.repeat(np.arange(b.num_rows), sizes)
                    width, hit = max(1, len(names)), found >= 0
                    cells, tf = np.unique(owner[hit] * width + found[hit], return_counts=True)
                    doc, term = cells // width, cells % width
                    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
                    scores = np.zeros((b.num_rows, len(ids)))
                    step = max(1, GAIN_CELLS // max(1, len(ids)))
                    for i in range(0, len(doc), step):  # sums of each document's rows; one that is cut goes on in the next part
                        own = doc[i : i + step]
                        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        scores[own[first]] += np.add.reduceat(gain[i : i + step, None] * matrix[term[i : i + step]], first, axis=0)
                    best.add(-scores.T, b.column(0).to_numpy())
            yield best.batch(ids, "score", -1.0)

        return words.mapInArrow(run, "query_id long, id long, score double")

    out: DataFrame | None = None
    block, vocabulary = [], set()
    for r in asked.orderBy("query_id").toLocalIterator():
        block.append((r["query_id"], Counter(r["terms"])))
        vocabulary |= set(r["terms"])
        if len(block) * len(vocabulary) >= QUERY_CELLS or len(block) == QUERY_BLOCK:
            part, block, vocabulary = scored(block, vocabulary), [], set()
            out = part if out is None else out.unionAll(part)
    if block or out is None:
        part = scored(block, vocabulary)
        out = part if out is None else out.unionAll(part)
    if known is None:
        stats.release()
    return ranked(out, k, F.round("score", 9).desc(), F.col("id"))


def _scaled(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.when(high > low, high - low).otherwise(1.0)


def fuse(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """Weighted sum of min-max scaled scores of two result lists; ties keep the vector order, then the lexical one."""
    w = Window.partitionBy("query_id")
    d, s = F.col("distance"), F.col("score")
    v = vector.select("query_id", "id", F.col("rank").alias("v_rank"), _scaled(F.max(d).over(w) - d, F.lit(0.0), F.max(d).over(w) - F.min(d).over(w)).alias("v"))
    t = lexical.select("query_id", "id", F.col("rank").alias("t_rank"), _scaled(s, F.min(s).over(w), F.max(s).over(w)).alias("t"))
    both = v.join(t, ["query_id", "id"], "full_outer").withColumn("score", F.coalesce(vector_weight * F.col("v"), F.lit(0.0)) + F.coalesce(lexical_weight * F.col("t"), F.lit(0.0)))
    return ranked(both, k, F.round("score", 9).desc(), F.col("v_rank").asc_nulls_last(), F.col("t_rank").asc_nulls_last()).select("query_id", "id", "score", "rank")


def hybrid_topk(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int, vector_weight: float = 0.6, lexical_weight: float = 0.4, terms: Terms = tokens, known: Statistics | None = None) -> DataFrame:
    """queries: query_id, embedding, content. Each side gives 2k candidates."""
    return fuse(vector_topk(vectors, queries.select("query_id", "embedding"), 2 * k), bm25_topk(docs, queries.select("query_id", "content"), 2 * k, terms, known), k, vector_weight, lexical_weight)


def reciprocal_rank_fusion(lists: DataFrame, k: int, c: int = 60) -> DataFrame:
    """lists: query_id, list (number), id, rank. Sum of 1 / (c + rank); ties keep the first list's order."""
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (c + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(fused, k, F.round("score", 12).desc(), F.col("first")).select("query_id", "id", "score", "rank")


Scorer = Callable[[Column, Column], Column]


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int, scorer: Scorer = containment) -> DataFrame:
    """candidates: query_id, id, rank. The scorer takes query and content Columns; a pandas UDF around a model fits as well."""
    joined = candidates.join(docs.select("id", F.col("content").alias("passage")), "id").join(queries.select("query_id", F.col("content").alias("asked")), "query_id")
    scored = joined.select("query_id", "id", F.col("rank").alias("before"), scorer(F.col("asked"), F.col("passage")).alias("score"))
    return ranked(scored, k, F.col("score").desc(), F.col("before")).select("query_id", "id", "score", "rank")


def rerank_topk(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int, initial: int = 10, scorer: Scorer = containment, terms: Terms = tokens, known: Statistics | None = None) -> DataFrame:
    return rerank(hybrid_topk(vectors, docs, queries, max(initial, 2 * k), terms=terms, known=known), docs, queries, k, scorer)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, k: int, reach: int = 1, factor: float = 0.8, score: str = "score") -> DataFrame:
    """Neighbours of hits in documents with two hits or more, in the order a reader would meet them.

    hits: query_id, id, rank and the score; chunks: id, doc, idx. The first k hits come in order; a hit of a
    document with another hit brings the chunks up to ``reach`` before and after it, whose score is the hit's
    times ``factor``. What came already does not come again, and a hit that came as a neighbour brings none.
    An equi-join on (doc, idx) finds the neighbours; the fold is an ``aggregate`` over each query's list of at most k hits, in the JVM.
    """
    named = hits.select("query_id", "id", "rank", F.col(score).cast("double").alias("score")).join(chunks.select("id", "doc", "idx"), "id")
    w = Window.partitionBy("query_id", "doc")
    gated = named.withColumn("clustered", F.count("*").over(w) >= 2).where(F.col("rank") <= k)
    steps = gated.withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).where("step = 0 OR clustered")
    near = chunks.select("doc", "idx", F.col("id").alias("near"))
    rows = steps.withColumn("idx", F.col("idx") + F.col("step")).join(near, ["doc", "idx"]).select("query_id", "rank", "step", "id", "near", "score")
    hit = rows.groupBy("query_id", "rank", "id").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.when(F.col("step") != 0, F.struct("step", "near")))).alias("near"))
    lists = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", F.transform("near", lambda x: x["near"]).alias("near")))).alias("hits"))

    def step(seen: Column, h: Column) -> Column:
        new = F.filter(F.array_distinct(h["near"]), lambda x: (x != h["id"]) & ~F.array_contains(seen["id"], x))
        ids = F.concat(seen["id"], F.array(h["id"]), new)
        scores = F.concat(seen["score"], F.array(h["score"]), F.transform(new, lambda _: h["score"] * factor))
        return F.when(F.array_contains(seen["id"], h["id"]), seen).otherwise(F.struct(ids.alias("id"), scores.alias("score")))

    none = F.struct(F.array().cast("array<bigint>").alias("id"), F.array().cast("array<double>").alias("score"))
    folded = lists.select("query_id", F.aggregate("hits", none, step).alias("seen"))
    found = folded.select("query_id", F.posexplode_outer(F.arrays_zip(F.col("seen.id").alias("id"), F.col("seen.score").alias("score"))).alias("at", "x"))
    return found.select("query_id", "x.id", "x.score", (F.col("at") + 1).alias("rank"))


def auto_merge(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, threshold: float = 0.4, scorer: Scorer = containment) -> DataFrame:
    """query_id, chunk_id, content, score, rank. candidates: query_id, id, score, rank; chunks: id, doc, idx, content.

    Where the candidates hold at least ``threshold`` of a document's chunks, they become the whole document.
    """
    totals = chunks.groupBy("doc").agg(F.count("*").alias("total"))
    hits = candidates.join(chunks.select("id", "doc", "idx", "content"), "id").withColumn("n", F.count("*").over(Window.partitionBy("query_id", "doc"))).join(totals, "doc")
    hits = hits.withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "doc")))
    whole = hits.where(F.col("n") >= threshold * F.col("total"))
    wanted = chunks.join(whole.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("parts"))
    texts = wanted.select("doc", F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n").alias("content"))
    merged = whole.select("query_id", "doc", "first").distinct().join(texts, "doc").select("query_id", F.concat(F.col("doc").cast("string"), F.lit("_merged")).alias("chunk_id"), "content", "first", F.lit(0).alias("rank"))
    single = hits.where(F.col("n") < threshold * F.col("total")).select("query_id", F.col("id").cast("string").alias("chunk_id"), "content", "first", "rank")
    both = merged.unionByName(single).join(queries.select("query_id", F.col("content").alias("asked")), "query_id")
    scored = both.withColumn("score", scorer(F.col("asked"), F.col("content"))).withColumnRenamed("rank", "own")
    return ranked(scored, k, F.col("score").desc(), F.col("first"), F.col("own")).select("query_id", "chunk_id", "content", "score", "rank")


def merge_windows(hits: DataFrame, k: int) -> DataFrame:
    """query_id, id, doc, window_start, window_end, distance, rank. hits: query_id, id, doc, window_start, window_end, distance, rank.

    One ``aggregate`` a query. In rank order, a hit whose window overlaps one already taken from its document widens the first such and brings
    nothing of its own; it stops once k windows are taken, so later overlaps are not merged.
    """

    h = ["id", "doc", "window_start", "window_end", "distance"]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *h))).alias("hits"))  # 2k rows a query

    def step(taken: Column, hit: Column) -> Column:
        clash = lambda t: (t["doc"] == hit["doc"]) & (hit["window_start"] < t["window_end"]) & (hit["window_end"] > t["window_start"])
        first = F.array_position(F.transform(taken, clash), True) - 1
        wider = lambda t: t.withField("window_start", F.least(t["window_start"], hit["window_start"])).withField("window_end", F.greatest(t["window_end"], hit["window_end"]))
        merged = F.transform(taken, lambda t, i: F.when(i == first, wider(t)).otherwise(t))
        return F.when(F.size(taken) >= k, taken).when(F.exists(taken, clash), merged).otherwise(F.concat(taken, F.array(hit)))

    folded = lists.select("query_id", F.aggregate("hits", F.slice("hits", 1, 0), step).alias("taken"))
    return folded.select("query_id", F.posexplode_outer("taken").alias("at", "x")).select("query_id", *[f"x.{c}" for c in h], (F.col("at") + 1).alias("rank"))


def expand_windows(windows: DataFrame, sentences: DataFrame) -> DataFrame:
    """windows with the text of the sentences from window_start to before window_end. sentences: doc, idx, content."""
    at = windows.withColumn("idx", F.explode(F.sequence(F.col("window_start"), F.col("window_end") - 1)))
    own = at.join(sentences.select("doc", "idx", "content"), ["doc", "idx"]).groupBy(*windows.columns).agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("parts"))
    return own.select(*windows.columns, F.array_join(F.transform("parts", lambda x: x["content"]), " ").alias("expanded"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, shared, only_a, only_b: what two result lists have in common."""
    both = a.select("query_id", "id", F.lit(1).alias("a")).join(b.select("query_id", "id", F.lit(1).alias("b")), ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def average_overlap(base: DataFrame, others: DataFrame) -> DataFrame:
    """retriever, overlap_pct: the mean share, in per cent, of each query's base results that the retriever has too. others: retriever, query_id, id."""
    sizes = base.groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    names = others.select("retriever").distinct()
    shared = others.select("retriever", "query_id", "id").distinct().join(base.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("retriever", "query_id").agg(F.count("*").alias("shared"))
    every = sizes.crossJoin(F.broadcast(names))  # a row for each query and retriever: names are those of the registry
    return every.join(shared, ["retriever", "query_id"], "left").groupBy("retriever").agg(F.round(F.avg(100 * F.coalesce("shared", F.lit(0)) / F.col("n")), 1).alias("overlap_pct"))


@dataclass
class Corpus:
    """What retrievers search. vectors: id, embedding; docs: id, content; chunks: id, doc, idx, content;
    sentences: id, doc, idx, content, window_start, window_end. embed: the model of the vectors, for texts that come
    without one (other forms of a query, sentences). terms: how BM25 makes terms of texts. sentences_in: the sentences of some documents (doc), where
    sentences have ids by ``sentence_id``. lexical, nearest: searches (queries, k) of stored indexes of docs and of vectors, in place of scans. The statistics of docs are counted at the first search that asks for them and serve all later ones, until ``release``."""

    vectors: DataFrame
    docs: DataFrame
    chunks: DataFrame
    sentences: DataFrame | None = None
    embed: Callable[[Column], Column] = hashed_bag
    terms: Terms = tokens
    sentences_in: Callable[[DataFrame], DataFrame] | None = None
    lexical: Callable[[DataFrame, int], DataFrame] | None = None
    nearest: Callable[[DataFrame, int], DataFrame] | None = None
    _known: Statistics | None = None

    def known(self) -> Statistics:
        if self._known is None:
            self._known = statistics(self.docs, self.terms)
        return self._known

    def release(self) -> None:
        if self._known is not None:
            self._known.release()
            self._known = None


Retriever = Callable[[Corpus, DataFrame, int], DataFrame]


def variants(content: Column) -> list[Column]:
    """The three forms of a query that multiquery asks besides the query where no model rewrites it: its first half, its second and its words without stop words."""
    words = F.split(content, " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    return [F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "), F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS)), " ")]


def _lexical(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return c.lexical(q.select("query_id", "content"), k) if c.lexical else bm25_topk(c.docs, q, k, c.terms, c.known())


def _nearest(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return c.nearest(q.select("query_id", "embedding"), k) if c.nearest else vector_topk(c.vectors, q, k)


def _hybrid(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return fuse(_nearest(c, q, 2 * k), _lexical(c, q, 2 * k), k)


def _reranked(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return rerank(_hybrid(c, q, max(10, 2 * k)), c.docs, q, k)


def multiquery(corpus: Corpus, queries: DataFrame, k: int, forms: Callable[[Column], list[Column]] = variants, base: Retriever = _reranked) -> DataFrame:
    """Each query and its other forms, 2k results of the base retriever each, fused by reciprocal ranks. All forms are embedded anew. A query_id of 2**61 or more raises, as a form's number does not fit."""
    every = [F.col("content"), *forms(F.col("content"))]
    n = len(every)
    asked = reduce(DataFrame.unionByName, [queries.select((F.col("query_id") * n + i).alias("query_id"), f.alias("content")) for i, f in enumerate(every)])
    found = base(corpus, asked.withColumn("embedding", corpus.embed(F.col("content"))), 2 * k)
    form = F.pmod(F.col("query_id"), F.lit(n))
    lists = found.select(F.expr(f"(query_id - pmod(query_id, {n}L)) div {n}L").alias("query_id"), form.cast("int").alias("list"), "id", "rank")
    return reciprocal_rank_fusion(lists, k)


def sentence_id(doc: Column, idx: Column) -> Column:
    """One number for a document and an index that is an int; it grows with both. A document beyond 32 bits raises."""
    fits = doc.between(-(1 << 32), (1 << 32) - 1)
    return F.when(doc.isNotNull() & ~fits, F.raise_error(F.lit("sentence ids need doc_id within 32 bits")).cast("long")).otherwise(doc * (1 << 31) + idx)


def sentence_window(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """2k sentences by vector search, widened to their windows; windows that overlap become one.

    All sentences are embedded and searched in one pass. Where the corpus has ``sentences_in``, only documents with a hit are split again for the windows.
    """
    bagged = corpus.embed is hashed_bag  # hashed words go to the search as they are
    embed = signed_buckets if bagged else corpus.embed
    embedded = corpus.sentences.select("id", embed(F.col("content")).alias("embedding"))
    near = vector_topk(embedded, queries.select("query_id", embed(F.col("content")).alias("embedding")), 2 * k, bagged).persist(StorageLevel.DISK_ONLY)  # 2k rows a query
    rows = corpus.sentences if corpus.sentences_in is None else corpus.sentences_in(near.select(F.shiftright("id", 31).alias("doc")).distinct())
    hits = near.join(rows.select("id", "doc", "window_start", "window_end"), "id")
    return expand_windows(merge_windows(hits, k), rows)


def _expanded(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return expand_neighbours(_hybrid(c, q, 2 * k), c.chunks, k)


#: Retrievers by name: (corpus, queries of query_id, content, embedding, k) to ranked rows.
RETRIEVERS: dict[str, Retriever] = {
    "vector": _nearest,
    "bm25": _lexical,
    "hybrid": _hybrid,
    "rerank": _reranked,
    "parent_child": lambda c, q, k: expand_neighbours(_nearest(c, q, 2 * k), c.chunks, k, factor=1.2, score="distance"),
    "multiquery": multiquery,
    "hybrid_parent_child": _expanded,
    "hybrid_parent_child_rerank": lambda c, q, k: rerank(_expanded(c, q, max(10, 2 * k)), c.docs, q, k),
    "auto_merge": lambda c, q, k: auto_merge(_hybrid(c, q, max(20, 4 * k)), c.chunks, q, k),
    "sentence_window": sentence_window,
}


def as_similarity(rows: DataFrame) -> DataFrame:
    """Results by distance as results by similarity, greatest first."""
    return rows.select("query_id", "id", (1 - F.col("distance")).alias("score"), "rank")


#: The variants that rank by similarity: the reranker's pool is always 10, neighbours get 0.8 of a hit's similarity.
SIMILARITY_RETRIEVERS: dict[str, Retriever] = {
    "vector": lambda c, q, k: as_similarity(_nearest(c, q, k)),
    "bm25": RETRIEVERS["bm25"],
    "hybrid": RETRIEVERS["hybrid"],
    "rerank": lambda c, q, k: rerank(_hybrid(c, q, 10), c.docs, q, k),
    "parent_child": lambda c, q, k: expand_neighbours(as_similarity(_nearest(c, q, 2 * k)), c.chunks, k, factor=0.8),
}
#: Registries by backend; the second knows its own names alone.
BACKENDS = {"custom": RETRIEVERS, "similarity": SIMILARITY_RETRIEVERS}


def retrieve(name: str, corpus: Corpus, queries: DataFrame, k: int = 5, strict: bool = False, backend: str = "custom") -> DataFrame:
    """Results of the named retriever. An unknown name means vector search, or raises if strict or of the similarity backend."""
    known = BACKENDS[backend]
    if name not in known and (strict or backend != "custom"):
        raise ValueError(f"unknown retriever: {name}")
    return known.get(name, known["vector"])(corpus, queries, k)


def compare(names: list[str], corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """retriever, query_id, id, rank of each of the named retrievers that return ids: one corpus, its statistics counted once."""
    return reduce(DataFrame.unionByName, [retrieve(n, corpus, queries, k, strict=True).select(F.lit(n).alias("retriever"), "query_id", "id", "rank") for n in names])


def results(name: str, corpus: Corpus, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, chunk_id (string), content, score of any retriever: merged documents with their texts, sentences with their windows' texts, all else with the text of its id."""
    found = retrieve(name, corpus, queries, k, strict=True)
    score = F.col("score" if "score" in found.columns else "distance").alias("score")
    if "expanded" in found.columns:
        return found.select("query_id", "rank", F.col("id").cast("string").alias("chunk_id"), F.col("expanded").alias("content"), score)
    if "chunk_id" in found.columns:
        return found.select("query_id", "rank", "chunk_id", "content", score)
    return found.join(corpus.docs.select("id", "content"), "id").select("query_id", "rank", F.col("id").cast("string").alias("chunk_id"), "content", score)


def register(name: str, retriever: Retriever, backend: str = "custom") -> None:
    """Add a retriever to a backend's registry; a name that is taken raises."""
    if name in BACKENDS[backend]:
        raise ValueError(f"there is a retriever of that name: {name}")
    BACKENDS[backend][name] = retriever
