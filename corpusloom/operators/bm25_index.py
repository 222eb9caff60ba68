"""A stored inverted index for BM25, searched without reading the texts.

Documents are put in order of id and dealt to ranges of RANGE documents. A posting row is a term's share of one range: ids,
occurrences and lengths, and the greatest gain that any of them has, its block maximum. Rows lie in buckets by a
hash of the term, so a search reads the buckets of its terms alone, of Parquet folders that Spark prunes, and of these the row groups that may hold them.

A search takes a range at a time. The block maxima give the most that any document of the range can score for a query; ranges that
cannot reach a query's k-th score so far are not scored for it, and where that holds for all queries their postings
are not even decoded. Scores are those of ``bm25_topk`` of the same documents, ties and documents without a match included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.retrieval import EPSILON, K1, QUERY_BLOCK, QUERY_CELLS, B, Terms, _Best, ranked
from corpusloom.session import small_batches, trim
from corpusloom.storage import delete

#: Tokens whose postings are counted together.
TOKENS = 1 << 18
#: Documents of a range, buckets of terms, bytes of a row group of postings (small ones let a search skip more), queries scored together, least ids that are remembered for queries with few matches.
RANGE, BUCKETS, ROW_GROUP, QUERIES, FIRST = 4096, 64, 4 << 20, 64, 1000

POSTINGS, TERMS, DOCUMENTS = "term string, part int, ids array<long>, counts array<int>, lengths array<int>, most double, bucket int", "term string, df long, bucket int", "id long, part int"


@dataclass
class Bm25Index:
    """An index at ``path``: documents, their mean length, the mean weight of terms, and how texts become terms."""

    spark: SparkSession
    path: str
    n: int
    mean: float
    mean_weight: float
    buckets: int
    first: list[int]  # the least ids, FIRST of them
    terms: Terms = tokens

    @property
    def postings(self) -> DataFrame:
        """bucket, term, part (range), ids, counts, lengths, most (the greatest gain)."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    @property
    def vocabulary(self) -> DataFrame:
        """bucket, term, df."""
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    @property
    def documents(self) -> DataFrame:
        """id, part."""
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/documents")

    @classmethod
    def load(cls, spark: SparkSession, path: str, terms: Terms = tokens) -> Bm25Index:
        r = spark.read.parquet(f"{path}/corpus").first()
        return cls(spark, path, r["n"], r["mean"], r["mean_weight"], r["buckets"], r["first"], terms)


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """The same in Python: the hash is XXH64 with seed 42, as a signed number."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (h >> 63 << 64)) % buckets


def _counted(low: list[int] | None):
    """term, part, id, count, length for the distinct terms of each document; batches of id, terms and, where the parts' first ids are not given, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            parts = batch.column(2).to_numpy() if low is None else np.searchsorted(np.array(low, np.int64), ids, side="right") - 1
            cut = np.cumsum(sizes) // TOKENS  # documents of about so many tokens, or one, at a time
            bounds = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), len(cut)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                lists = pa.concat_arrays([batch.column(1).slice(lo, hi - lo)])
                words = lists.flatten().dictionary_encode()
                if not len(words):
                    continue
                n = len(words.dictionary)
                cells, counts = np.unique(np.repeat(np.arange(lo, hi), sizes[lo:hi]) * n + words.indices.to_numpy().astype(np.int64), return_counts=True)
                row = cells // n
                columns = [words.dictionary.take(pa.array(cells % n)), *(pa.array(x) for x in (parts[row].astype(np.int32), ids[row], counts.astype(np.int32), sizes[row].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "part", "id", "count", "length"])
        trim()

    return run


def build(docs: DataFrame, path: str, terms: Terms = tokens, size: int = RANGE, buckets: int = BUCKETS) -> Bm25Index:
    """Write the index of docs (id, content) to ``path``, which must not exist, and return it.

    Texts are read once, after a pass over the ids. Postings are shuffled once, by ranges of (bucket, part, term), so a frequent term is
    spread over as many tasks as it has parts; they are written twice, as their greatest gains need the mean length. A null text has no terms; ids must be distinct; documents without an id are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "content")
    # ranges of ids: parts of an order by id count what comes before them
    rows.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.spark_partition_id()).write.parquet(f"{path}/ids")
    ids = spark.read.schema("id long, at int").parquet(f"{path}/ids")
    w = Window.orderBy("at")  # a row for each task
    before = ids.groupBy("at").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("at").orderBy("id")) - 1 + F.col("before")
    ids.join(F.broadcast(before), "at").select("id", F.floor(number / size).cast("int").alias("part")).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/documents")
    delete(spark, f"{path}/ids")
    known = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents")
    n = known.count()

    listed = rows.select("id", terms(F.coalesce("content", F.lit(""))).alias("terms"))
    low = None
    if n <= EDGES * size:
        low = [r["low"] for r in known.groupBy("part").agg(F.min("id").alias("low")).orderBy("part").collect()]
    else:
        listed = listed.join(known, "id")
    each = listed.mapInArrow(_counted(low), "term string, part int, id long, count int, length int")
    spread = each.withColumn("bucket", _bucket("term", buckets)).repartitionByRange("bucket", "part", "term")
    lists = spread.groupBy("bucket", "part", "term").agg(F.array_sort(F.collect_list(F.struct("id", "count", "length"))).alias("p"))  # at most ``size`` postings
    lists.select("term", "part", F.col("p.id").alias("ids"), F.col("p.count").alias("counts"), F.col("p.length").alias("lengths"), "bucket").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/lists")
    lists = spark.read.schema("term string, part int, ids array<long>, counts array<int>, lengths array<int>, bucket int").parquet(f"{path}/lists")
    length = lists.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    mean = (length / n if n else 0) or 1.0
    gain = F.zip_with("counts", "lengths", lambda tf, own: tf * (K1 + 1) / (tf + K1 * (1 - B + B * own / mean)))
    whole = lists.select("term", "part", "ids", "counts", "lengths", F.array_max(gain).alias("most"), "bucket")
    whole.repartitionByRange("bucket", "term", "part").sortWithinPartitions("bucket", "term", "part").write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    delete(spark, f"{path}/lists")
    df = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df"))
    df.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    weight = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_weight = spark.read.schema(TERMS).parquet(f"{path}/terms").agg(F.avg(weight)).first()[0] or 0.0
    first = [r["id"] for r in known.orderBy("id").limit(FIRST).select("id").collect()]
    spark.createDataFrame([(n, mean, mean_weight, buckets, first)], "n long, mean double, mean_weight double, buckets int, first array<long>").coalesce(1).write.parquet(f"{path}/corpus")
    return Bm25Index(spark, path, n, mean, mean_weight, buckets, first, terms)


#: First ids of parts that are sent to the tasks (a megabyte; half a billion documents), beyond which documents are joined with their parts.
EDGES = 1 << 17


class _Scorer:
    """The k best documents of each query of a block, range by range. weights: terms by queries, not negative ones alone."""

    def __init__(self, weights: np.ndarray, k: int, mean: float, first: np.ndarray):
        self.weights, self.k, self.mean, self.first = weights, k, mean, first
        self.bound = np.maximum(weights, 0)
        self.best = _Best(weights.shape[1], k)
        self.always: list[tuple[np.ndarray, np.ndarray]] = []  # of the corpus's first documents: ids and scores by query
        self.skipped = self.scored = 0

    def take(self, term: np.ndarray, most: np.ndarray, postings: pa.RecordBatch) -> None:
        """A range's rows of terms; postings: ids, counts, lengths."""
        full = self.best.values.shape[1] == self.k
        least = -self.best.values[:, -1] if full and self.k else np.full(self.weights.shape[1], -np.inf)
        live = most @ self.bound[term] >= least - 1e-9
        self.scored, self.skipped = self.scored + int(live.sum()), self.skipped + int((~live).sum())
        if not live.any():
            return
        lists = [pa.concat_arrays([c]) for c in postings.columns]
        ids, counts, lengths = (c.flatten().to_numpy() for c in lists)
        owner = np.repeat(term, np.diff(lists[0].offsets.to_numpy()))
        order = np.lexsort((owner, ids))
        starts = np.flatnonzero(np.append(True, ids[order[1:]] != ids[order[:-1]]))
        for i in range(0, len(starts), DOCS):  # what is held of documents by queries grows with neither
            part = order[starts[i] : starts[i + DOCS] if i + DOCS < len(starts) else None]
            self._score(np.flatnonzero(live), ids[part], owner[part], counts[part].astype(np.float64), lengths[part])

    def _score(self, asked: np.ndarray, ids: np.ndarray, owner: np.ndarray, tf: np.ndarray, length: np.ndarray) -> None:
        """Postings of some documents, in order of documents and terms."""
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))
        docs, at = np.unique(ids, return_inverse=True)
        for q in range(0, len(asked), QUERIES):
            own = asked[q : q + QUERIES]
            weights, scores = self.weights[:, own], np.zeros((len(docs), len(own)))
            for i in range(0, len(ids), STEP):  # sums of each document's terms; one that is cut goes on in the next part
                part = at[i : i + STEP]
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                scores[part[first]] += np.add.reduceat(gain[i : i + STEP, None] * weights[owner[i : i + STEP]], first, axis=0)
            held = np.full((self.weights.shape[1], len(docs)), np.inf) if len(own) < self.weights.shape[1] else None
            values = -scores.T
            if held is not None:
                held[own] = values
                values = held
            self.best.add(values, docs)
            early = np.isin(docs, self.first)
            if early.any():
                self.always.append((own, docs[early], scores[early].T))

    def batches(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = self.best.batch(queries, "score", -1.0)
        yield found.filter(pa.array(np.isfinite(found.column(2).to_numpy())))
        for own, docs, scores in self.always:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[own], len(docs))), pa.array(np.tile(docs, len(own))), pa.array(scores.ravel() + 0.0)], ["query_id", "id", "score"])


#: Postings whose gains are spread over QUERIES queries at a time, and documents that are scored at a time.
STEP, DOCS = 1 << 14, 512


#: Terms that a search names to the Parquet reader, so that row groups without them are skipped; more are joined.
FEW = 1000


def _of(rows: DataFrame, terms: set[str]) -> DataFrame:
    if len(terms) <= FEW:
        return rows.where(F.col("term").isin(sorted(terms)))
    named = rows.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string")
    return rows.join(F.broadcast(named), "term", "left_semi")


def search(index: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank as ``bm25_topk`` gives them, from the index; documents without a match score 0 and follow in order of id. queries: query_id, content.

    Queries go out in blocks of at most QUERY_BLOCK whose matrix has at most QUERY_CELLS cells. A task holds the k best
    of each query of a block and the postings of one range of documents at a time.
    """
    spark, mean = index.spark, index.mean
    small_batches(spark)
    first = index.first[:k] if k <= len(index.first) or len(index.first) == index.n else [r["id"] for r in index.documents.orderBy("id").limit(k).select("id").collect()]
    first = np.array(first, np.int64)
    asked = queries.select("query_id", index.terms(F.coalesce("content", F.lit(""))).alias("terms"))
    numbered = "query_id long, id long, score double"

    def scored(block: list[tuple[int, Counter]], vocabulary: set[str]) -> DataFrame:
        buckets = sorted({bucket_of(t, index.buckets) for t in vocabulary})
        known = _of(index.vocabulary.where(F.col("bucket").isin(buckets)), vocabulary)
        weight = F.log(F.lit(index.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        found = sorted((r["term"], r["w"] if r["w"] >= 0 else EPSILON * index.mean_weight) for r in known.select("term", weight.alias("w")).collect())
        place = {t: i for i, (t, _) in enumerate(found)}
        matrix = np.zeros((len(found), len(block)))
        for j, (_, c) in enumerate(block):
            for t, n in c.items():
                if t in place:
                    matrix[place[t], j] = n * found[place[t]][1]
        held = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), [t for t, _ in found], matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, matrix = held.value
            names = pa.array(names, pa.string())
            scorer = _Scorer(matrix, k, mean, first)
            rest: list[pa.RecordBatch] = []

            def done() -> None:
                rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                scorer.take(pc.index_in(rows.column(1), value_set=names).to_numpy(), rows.column(2).to_numpy(), rows.select([3, 4, 5]))
                rest.clear()

            for batch in batches:
                part = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if rest and hi > lo and rest[0].column(0)[0].as_py() != part[lo]:
                        done()
                    if hi > lo:
                        rest.append(batch.slice(lo, hi - lo))
            if rest:
                done()
            yield from scorer.batches(ids)
            trim()

        rows = _of(index.postings.where(F.col("bucket").isin(buckets)), set(place)).select("part", "term", "most", "ids", "counts", "lengths")
        return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, numbered)

    out, block, vocabulary = [], [], set()
    for r in asked.orderBy("query_id").toLocalIterator():
        block.append((r["query_id"], Counter(r["terms"])))
        vocabulary |= set(r["terms"])
        if len(block) * len(vocabulary) >= QUERY_CELLS or len(block) == QUERY_BLOCK:
            out.append(scored(block, vocabulary))
            block, vocabulary = [], set()
    if block:
        out.append(scored(block, vocabulary))
    zero = asked.select("query_id", F.explode(F.lit(first.tolist()).cast("array<bigint>")).alias("id"), F.lit(0).alias("known"), F.lit(0.0).alias("score"))
    for part in out:
        zero = zero.unionByName(part.select("query_id", "id", F.lit(1).alias("known"), "score"))
    each = zero.groupBy("query_id", "id").agg(F.max(F.struct("known", "score"))["score"].alias("score"))
    return ranked(each, k, F.round("score", 9).desc(), F.col("id")).select("query_id", "id", "score", "rank")


