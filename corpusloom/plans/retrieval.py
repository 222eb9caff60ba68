"""Queries over retrieval. Benchmark items ask, documents and embeddings answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import bm25_index
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_index
from corpusloom.operators.chunk import line_chunks, nodes, sentence_chunks, stemmed_tokens, window_text
from corpusloom.operators.serving import context_of, index
from corpusloom.plans.base import bag_sql, query, sentences_sql, table, tokens_sql
from corpusloom.plans.evaluation import _COUNTS
from corpusloom.storage import new_folder

K = 5


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with its text and the vector of the same number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    return items.join(_vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding"), "query_id", "left")


def _chunks(spark, sf_dir) -> DataFrame:
    """Vectors as chunks: the label is the document, the order of vec_id the place in it."""
    w = Window.partitionBy("label").orderBy("id")
    return _vectors(spark, sf_dir).select("id", F.col("label").cast("long").alias("doc"), (F.row_number().over(w) - 1).alias("idx"))


_VECTOR = """
q AS (SELECT b.item_id AS query_id, b.text, e.embedding AS v FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
vd AS (SELECT query_id, vec_id AS id, label, 1 - list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance FROM q, embeddings e WHERE q.v IS NOT NULL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM vd)"""
_BM25 = f"""
dt AS (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS term FROM documents),
dl AS (SELECT doc_id AS id, len({tokens_sql('text')}) AS n_terms FROM documents),
st AS (SELECT count(*) AS n, avg(n_terms) AS m FROM dl),
po AS (SELECT term, id, count(*) AS tf FROM dt GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
ra AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM df, st),
id AS (SELECT term, CASE WHEN w < 0 THEN (SELECT 0.25 * avg(w) FROM ra) ELSE w END AS w FROM ra),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, po.id, sum(times * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / m))) AS score FROM qt JOIN id USING (term) JOIN po USING (term) JOIN dl ON dl.id = po.id, st GROUP BY 1, 2),
ba AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.query_id = b.item_id AND sc.id = d.doc_id),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ba)"""


def _hybrid(k: int, name: str = "hy") -> str:
    return f"""
{name}_v AS (SELECT query_id, id, rank, 0.6 * (max(distance) OVER w - distance) / CASE WHEN max(distance) OVER w > min(distance) OVER w THEN max(distance) OVER w - min(distance) OVER w ELSE 1.0 END AS s FROM vr WHERE rank <= {2 * k} WINDOW w AS (PARTITION BY query_id)),
{name}_b AS (SELECT query_id, id, rank, 0.4 * (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END AS s FROM br WHERE rank <= {2 * k} WINDOW w AS (PARTITION BY query_id)),
{name}_f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, coalesce(v.s, 0) + coalesce(b.s, 0) AS score, v.rank AS v_rank, b.rank AS b_rank FROM {name}_v v FULL JOIN {name}_b b ON v.query_id = b.query_id AND v.id = b.id),
{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, v_rank NULLS LAST, b_rank NULLS LAST) AS rank FROM {name}_f) WHERE rank <= {k})"""


_SETS = f"""
ds AS (SELECT doc_id AS id, list_distinct({tokens_sql('text')}) AS d FROM documents),
qs AS (SELECT item_id AS query_id, list_distinct({tokens_sql('text')}) AS w FROM benchmark)"""


def _containment(a: str, b: str) -> str:
    from corpusloom.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    kept = lambda x: f"list_filter({x}, lambda x: x NOT IN ({stop}))"
    return f"CASE WHEN len({kept(a)}) = 0 THEN 0.0 ELSE len(list_intersect({kept(a)}, {kept(b)})) / len({kept(a)}) END"


@query(f"WITH {_VECTOR} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM vr WHERE rank <= {K}")
def cosine_topk(spark, sf_dir):
    return R.vector_topk(_vectors(spark, sf_dir), _queries(spark, sf_dir), K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_VECTOR} SELECT query_id, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM vr WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {K}")
def cosine_topk_filtered(spark, sf_dir):
    return R.vector_topk(_vectors(spark, sf_dir).where("label = 3"), _queries(spark, sf_dir), K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank <= {K}")
def bm25_topk(spark, sf_dir):
    return R.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VECTOR} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM vr WHERE rank <= {K}")
def vector_indexed(spark, sf_dir):
    """The same search from a stored index of lists, exact by its bounds."""
    index = vector_index.build(_vectors(spark, sf_dir), new_folder(spark, "vectors"))
    return vector_index.search(index, _queries(spark, sf_dir), K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_VECTOR} SELECT query_id, count(*) AS n, true AS enough FROM vr WHERE rank <= 10 GROUP BY 1")
def vector_index_recall(spark, sf_dir):
    """Whether a search of as many lists as the index's own members need finds at least 95 in 100 of the queries' ten nearest, over all queries: measured against the exact search."""
    index = vector_index.build(_vectors(spark, sf_dir), new_folder(spark, "vectors"))
    found = vector_index.recall(index, _queries(spark, sf_dir), 10, vector_index.probes_for(index, 10))
    whole = found.agg((F.sum("found") / F.sum("n") >= 0.95).alias("enough"))
    return found.select("query_id", "n").join(F.broadcast(whole))


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank <= {K}")
def bm25_indexed(spark, sf_dir):
    """The same search from a stored inverted index, which is built first."""
    index = bm25_index.build(_docs(spark, sf_dir), new_folder(spark, "bm25"))
    return bm25_index.search(index, _queries(spark, sf_dir), K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VECTOR}, {_BM25}, {_hybrid(K)} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hy")
def hybrid_fusion(spark, sf_dir):
    found = R.hybrid_topk(_vectors(spark, sf_dir), _docs(spark, sf_dir), _queries(spark, sf_dir), K)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_VECTOR}, {_BM25}, li AS (SELECT query_id, id, 0 AS list, rank FROM vr WHERE rank <= {2 * K} UNION ALL SELECT query_id, id, 1, rank FROM br WHERE rank <= {2 * K}),
fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM li GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM fu WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) QUALIFY row_number() OVER w <= {K}""")
def rrf_fusion(spark, sf_dir):
    q = _queries(spark, sf_dir)
    v = R.vector_topk(_vectors(spark, sf_dir), q, 2 * K).select("query_id", F.lit(0).alias("list"), "id", "rank")
    b = R.bm25_topk(_docs(spark, sf_dir), q, 2 * K).select("query_id", F.lit(1).alias("list"), "id", "rank")
    return R.reciprocal_rank_fusion(v.unionByName(b), K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(2 * K)}, {_SETS},
re AS (SELECT hy.query_id, hy.id, hy.rank AS before, {_containment('w', 'd')} AS score FROM hy JOIN ds ON ds.id = hy.id JOIN qs ON qs.query_id = hy.query_id)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM re WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, before) QUALIFY row_number() OVER w <= {K}""")
def rerank_overlap(spark, sf_dir):
    found = R.rerank_topk(_vectors(spark, sf_dir), _docs(spark, sf_dir), _queries(spark, sf_dir), K)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _sentence_rows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text."""
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("guide").alias("content_type"), F.col("text").alias("content"))
    return sentence_chunks(named).select(R.sentence_id(F.col("doc_id").cast("long"), F.col("sentence_index")).alias("id"), F.col("doc_id").cast("long").alias("doc"), F.col("sentence_index").alias("idx"), "content", "window_start", "window_end")


def _corpus(spark, sf_dir) -> R.Corpus:
    docs = table(spark, sf_dir, "documents")
    some = lambda kept: _sentence_rows(docs.join(kept.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"))
    return R.Corpus(_vectors(spark, sf_dir), _docs(spark, sf_dir), _chunks(spark, sf_dir), _sentence_rows(docs), sentences_in=some)


@query()
def multiquery(spark, sf_dir):
    docs = _docs(spark, sf_dir)  # other forms of a query need the model of the vectors, so the documents are embedded too
    return R.retrieve("multiquery", R.Corpus(index(docs).select("id", "embedding"), docs, _chunks(spark, sf_dir)), _queries(spark, sf_dir), K)


@query()
def bm25_stemmed(spark, sf_dir):
    """BM25 over stems; its SQL would need the stemmer, so a test holds it against brute force."""
    return R.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), K, stemmed_tokens).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_CHUNKS = """ch AS (SELECT vec_id AS id, label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings)"""


def _fold(hits: str, score: str, k: int, factor: float, name: str) -> str:
    """Neighbour expansion of ``hits`` (query_id, id, rank and the score): one recursion a hit, in the order of ranks."""
    return f"""
{name}_h AS (SELECT h.query_id, h.id, h.rank, h.{score} AS s, c.doc, c.idx, count(*) OVER (PARTITION BY h.query_id, c.doc) >= 2 AS clustered FROM {hits} h JOIN ch c ON c.id = h.id WHERE h.rank <= {2 * k}),
{name}_n AS (SELECT h.query_id, h.id, h.s, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS r,
  list_filter([CASE WHEN h.clustered THEN b.id END, CASE WHEN h.clustered THEN a.id END], lambda x: x IS NOT NULL) AS near
  FROM {name}_h h LEFT JOIN ch b ON b.doc = h.doc AND b.idx = h.idx - 1 LEFT JOIN ch a ON a.doc = h.doc AND a.idx = h.idx + 1 WHERE h.rank <= {k}),
{name}_r AS (SELECT query_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[]) AS scores FROM (SELECT DISTINCT query_id FROM {name}_n)
  UNION ALL SELECT f.query_id, f.r + 1, CASE WHEN list_contains(f.ids, n.id) THEN f.ids ELSE f.ids || [n.id] || list_filter(n.near, lambda x: NOT list_contains(f.ids, x)) END,
  CASE WHEN list_contains(f.ids, n.id) THEN f.scores ELSE f.scores || [n.s] || list_transform(list_filter(n.near, lambda x: NOT list_contains(f.ids, x)), lambda x: n.s * {factor}) END
  FROM {name}_r f JOIN {name}_n n ON n.query_id = f.query_id AND n.r = f.r + 1),
{name} AS (SELECT query_id, unnest(ids) AS id, unnest(scores) AS score, unnest(range(1, len(ids) + 1)) AS rank FROM {name}_r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1)"""


def _rounded(found):
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_FOUND = "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM"


@query(f"WITH RECURSIVE {_VECTOR}, {_CHUNKS}, {_fold('vr', 'distance', K, 1.2, 'ex')} {_FOUND} ex")
def parent_child(spark, sf_dir):
    return _rounded(R.retrieve("parent_child", _corpus(spark, sf_dir), _queries(spark, sf_dir), K))


@query(f"WITH RECURSIVE {_VECTOR}, {_BM25}, {_hybrid(2 * K)}, {_CHUNKS}, {_fold('hy', 'score', K, 0.8, 'ex')} {_FOUND} ex")
def hybrid_parent_child(spark, sf_dir):
    return _rounded(R.retrieve("hybrid_parent_child", _corpus(spark, sf_dir), _queries(spark, sf_dir), K))


_RANKED = "CAST(row_number() OVER w AS INTEGER) AS rank FROM re WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, before) QUALIFY row_number() OVER w <="


@query(f"""
WITH RECURSIVE {_VECTOR}, {_BM25}, {_hybrid(4 * K)}, {_CHUNKS}, {_fold('hy', 'score', 2 * K, 0.8, 'ex')}, {_SETS},
re AS (SELECT ex.query_id, ex.id, ex.rank AS before, {_containment('w', 'd')} AS score FROM ex JOIN ds ON ds.id = ex.id JOIN qs ON qs.query_id = ex.query_id)
SELECT query_id, id, round(score, 6) AS score, {_RANKED} {K}""")
def hybrid_parent_child_rerank(spark, sf_dir):
    return _rounded(R.retrieve("hybrid_parent_child_rerank", _corpus(spark, sf_dir), _queries(spark, sf_dir), K))


@query(f"WITH RECURSIVE {_VECTOR}, si AS (SELECT query_id, id, rank, 1 - distance AS score FROM vr), {_CHUNKS}, {_fold('si', 'score', K, 0.8, 'ex')} {_FOUND} ex")
def similarity_parent_child(spark, sf_dir):
    return _rounded(R.retrieve("parent_child", _corpus(spark, sf_dir), _queries(spark, sf_dir), K, backend="similarity"))


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(10)}, {_SETS},
re AS (SELECT hy.query_id, hy.id, hy.rank AS before, {_containment('w', 'd')} AS score FROM hy JOIN ds ON ds.id = hy.id JOIN qs ON qs.query_id = hy.query_id)
SELECT query_id, id, round(score, 6) AS score, {_RANKED} 8""")
def similarity_rerank(spark, sf_dir):
    return _rounded(R.retrieve("rerank", _corpus(spark, sf_dir), _queries(spark, sf_dir), 8, backend="similarity"))


def _parts(spark, sf_dir) -> DataFrame:
    """Documents as chunks of larger ones: three follow one another in each."""
    return _docs(spark, sf_dir).select("id", F.floor(F.col("id") / 3).alias("doc"), (F.col("id") % 3).cast("int").alias("idx"), "content")


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(4 * K)}, {_SETS}, ca AS (SELECT query_id, id, rank, id // 3 AS doc FROM hy),
pa AS (SELECT doc_id // 3 AS doc, count(*) AS total, list_distinct(flatten(list({tokens_sql('text')}))) AS d, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY 1),
gr AS (SELECT ca.*, count(*) OVER w AS n, min(rank) OVER w AS first FROM ca WINDOW w AS (PARTITION BY query_id, doc)),
al AS (SELECT DISTINCT query_id, concat(doc, '_merged') AS chunk_id, first, 0 AS own, d, content FROM gr JOIN pa USING (doc) WHERE n >= 0.4 * total
  UNION ALL SELECT query_id, CAST(gr.id AS VARCHAR), first, rank, ds.d, t.text FROM gr JOIN pa USING (doc) JOIN ds ON ds.id = gr.id JOIN documents t ON t.doc_id = gr.id WHERE n < 0.4 * total),
so AS (SELECT al.*, {_containment('w', 'd')} AS score FROM al JOIN qs USING (query_id))
SELECT query_id, chunk_id, md5(content) AS content, round(score, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM so WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, first, own) QUALIFY row_number() OVER w <= {K}""")
def auto_merge(spark, sf_dir):
    found = R.retrieve("auto_merge", R.Corpus(_vectors(spark, sf_dir), _docs(spark, sf_dir), _parts(spark, sf_dir)), _queries(spark, sf_dir), K)
    return found.select("query_id", "chunk_id", F.md5("content").alias("content"), F.round("score", 6).alias("score"), "rank")


_CLASH = "t.doc = n.doc AND n.window_start < t.window_end AND n.window_end > t.window_start"


@query(f"""
WITH RECURSIVE {sentences_sql("SELECT doc_id, text FROM documents")},
sn AS MATERIALIZED (SELECT doc_id AS doc, i AS idx, x AS content, greatest(0, i - 3) AS window_start, least(n, i + 4) AS window_end, {bag_sql('x')} AS v FROM (SELECT doc_id, len(s) AS n, unnest(s) AS x, unnest(range(len(s))) AS i FROM se)),
qv AS MATERIALIZED (SELECT item_id AS query_id, {bag_sql('text')} AS v FROM benchmark),
di AS (SELECT query_id, doc, idx, doc * 2147483648 + idx AS id, window_start, window_end, CASE WHEN list_sum(list_transform(q.v, lambda x: abs(x))) = 0 OR list_sum(list_transform(sn.v, lambda x: abs(x))) = 0 THEN 1.0 ELSE 1 - list_cosine_similarity(q.v, sn.v) END AS distance FROM qv q, sn),
ra AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM di) WHERE rank <= {2 * K}),
fo AS (SELECT query_id, CAST(0 AS BIGINT) AS r, list_filter([struct_pack(id := id, doc := doc, window_start := window_start, window_end := window_end, distance := distance)], lambda x: false) AS taken FROM ra WHERE rank = 1
  UNION ALL SELECT f.query_id, f.r + 1, CASE WHEN len(f.taken) >= {K} THEN f.taken WHEN len(list_filter(f.taken, lambda t: {_CLASH})) > 0
    THEN list_transform(f.taken, lambda t, i: CASE WHEN i = list_position(list_transform(f.taken, lambda t: {_CLASH}), true) THEN struct_pack(id := t.id, doc := t.doc, window_start := least(t.window_start, n.window_start), window_end := greatest(t.window_end, n.window_end), distance := t.distance) ELSE t END)
    ELSE f.taken || [struct_pack(id := n.id, doc := n.doc, window_start := n.window_start, window_end := n.window_end, distance := n.distance)] END
  FROM fo f JOIN ra n ON n.query_id = f.query_id AND n.rank = f.r + 1),
wi AS (SELECT query_id, unnest(taken) AS t, unnest(range(1, len(taken) + 1)) AS rank FROM fo QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1)
SELECT query_id, t.id AS id, CAST(t.window_start AS INTEGER) AS window_start, CAST(t.window_end AS INTEGER) AS window_end, round(t.distance, 6) AS distance, CAST(rank AS INTEGER) AS rank, md5(string_agg(content, ' ' ORDER BY idx)) AS expanded
FROM wi JOIN sn ON sn.doc = t.doc AND idx >= t.window_start AND idx < t.window_end GROUP BY ALL""")
def sentence_window(spark, sf_dir):
    found = R.retrieve("sentence_window", _corpus(spark, sf_dir), _queries(spark, sf_dir), K)
    return found.select("query_id", "id", "window_start", "window_end", F.round("distance", 6).alias("distance"), "rank", F.md5("expanded").alias("expanded"))


@query(f"""
WITH {_VECTOR}, {_BM25}, a AS (SELECT query_id, id FROM vr WHERE rank <= {2 * K}), b AS (SELECT query_id, id FROM br WHERE rank <= {2 * K})
SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS shared, count(*) FILTER (WHERE b.id IS NULL) AS only_a, count(*) FILTER (WHERE a.id IS NULL) AS only_b
FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY 1""")
def retriever_overlap(spark, sf_dir):
    q = _queries(spark, sf_dir)
    return R.overlap(R.vector_topk(_vectors(spark, sf_dir), q, 2 * K), R.bm25_topk(_docs(spark, sf_dir), q, 2 * K))


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS idx FROM documents)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, md5(string_agg(content, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS window_text FROM lines""")
def window_frame_concat(spark, sf_dir):
    rows = line_chunks(table(spark, sf_dir, "documents")).withColumnRenamed("chunk_index", "idx")
    return window_text(rows, 3).select("doc_id", "idx", F.md5("window_text").alias("window_text"))


@query(f"""
WITH {_BM25}, top AS (SELECT query_id, rank, source, lang, text FROM br JOIN documents ON doc_id = id WHERE rank <= 3)
SELECT query_id, md5(string_agg(concat('[Source ', rank, ': ', lang, ' (', source, ')]', chr(10), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM top GROUP BY 1""")
def context_assembly(spark, sf_dir):
    """The context as models get it, of whole texts."""
    hits = R.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), 3)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("source_url"), F.col("text").alias("content"))
    return context_of(hits, docs).select("query_id", F.md5("context").alias("context"))


@query(f"""
WITH {_BM25}, top AS (SELECT query_id, min(rank) AS rank, concat('- [', lang, '](', source, ')') AS line FROM br JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY query_id, lang, source)
SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS footer FROM top GROUP BY 1""")
def sources_footer(spark, sf_dir):
    hits = R.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), 10)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("- ["), "lang", F.lit("]("), "source", F.lit(")")).alias("line"))
    rows = hits.join(docs, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("parts"))
    return rows.select("query_id", F.array_join(F.array_distinct(F.transform("parts", lambda x: x["line"])), "\n").alias("footer"))


@query(f"""
WITH {_VECTOR}, tr AS (SELECT q.query_id, e.vec_id AS id FROM q JOIN embeddings s ON s.vec_id = q.query_id JOIN embeddings e ON e.label = s.label AND e.vec_id <> q.query_id),
n AS (SELECT query_id, count(*) AS n_true FROM tr GROUP BY 1),
m AS (SELECT vr.query_id, rank, tr.id IS NOT NULL AS good FROM vr LEFT JOIN tr ON tr.query_id = vr.query_id AND tr.id = vr.id WHERE rank <= 10),
p AS (SELECT query_id, count(*) AS k, count(*) FILTER (WHERE good) AS hits, min(rank) FILTER (WHERE good) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE good), 0) AS dcg FROM m GROUP BY 1),
r AS (SELECT n.query_id, coalesce(1.0 / first, 0) AS mrr, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit, hits / n_true AS recall,
      dcg / list_sum(list_transform(range(1, least(n_true, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM n JOIN p USING (query_id))
SELECT round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, count(*) AS n_queries FROM r""")
def mrr_hit_recall_ndcg(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _queries(spark, sf_dir)
    own = q.select("query_id").join(v.select(F.col("id").alias("query_id"), "label"), "query_id")
    sizes = own.join(v.groupBy("label").agg((F.count("*") - 1).alias("n_true")), "label").where("n_true > 0").select("query_id", "n_true")
    found = R.vector_topk(v, q, 10).join(v.select("id", F.col("label").alias("found")), "id").join(own, "query_id")
    return E.macro(E.metrics_of(found.withColumn("good", F.when((F.col("found") == F.col("label")) & (F.col("id") != F.col("query_id")), 1)), sizes))


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(10)},
al AS (SELECT 'vector' AS retriever, query_id, id, rank FROM vr WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, id, rank FROM br WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM hy),
n AS (SELECT b.item_id AS query_id, count(*) AS n_true FROM benchmark b JOIN documents d ON d.doc_id % 100 = b.item_id % 100 GROUP BY 1),
p AS (SELECT retriever, query_id, count(*) AS k, count(*) FILTER (WHERE id % 100 = query_id % 100) AS hits, min(rank) FILTER (WHERE id % 100 = query_id % 100) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE id % 100 = query_id % 100), 0) AS dcg FROM al GROUP BY 1, 2),
r AS (SELECT retriever, coalesce(1.0 / first, 0) AS mrr, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit, hits / n_true AS recall,
      dcg / list_sum(list_transform(range(1, least(n_true, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM n JOIN p USING (query_id))
SELECT retriever, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, count(*) AS n_queries FROM r GROUP BY retriever""")
def retriever_metrics(spark, sf_dir):
    """The retrieval-only evaluation: ranking metrics of several retrievers. True ids are those that agree with the query's in their last two digits."""
    corpus, q = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    found = R.compare(["vector", "bm25", "hybrid"], corpus, q, 10)
    sizes = q.select("query_id", (F.col("query_id") % 100).alias("d")).join(corpus.docs.groupBy((F.col("id") % 100).alias("d")).agg(F.count("*").alias("n_true")), "d").drop("d")
    marked = found.withColumn("good", F.when(F.col("id") % 100 == F.col("query_id") % 100, 1))
    each = [E.macro(E.metrics_of(marked.where(F.col("retriever") == n).drop("retriever"), sizes)).withColumn("retriever", F.lit(n)) for n in ("vector", "bm25", "hybrid")]
    return reduce(DataFrame.unionByName, each)


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(K)} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(id AS VARCHAR) AS chunk_id, md5(text) AS content, round(score, 6) AS score FROM hy JOIN documents ON doc_id = id""")
def result_lists(spark, sf_dir):
    found = R.results("hybrid", R.Corpus(_vectors(spark, sf_dir), _docs(spark, sf_dir), _chunks(spark, sf_dir)), _queries(spark, sf_dir), K)
    return found.withColumns({"content": F.md5("content"), "score": F.round("score", 6)})


@query(f"""
WITH {_VECTOR}, {_BM25}, {_hybrid(K)}, al AS (SELECT 'vector' AS retriever, query_id, id FROM vr WHERE rank <= {K} UNION ALL SELECT 'bm25', query_id, id FROM br WHERE rank <= {K}),
n AS (SELECT query_id, count(*) AS n FROM hy GROUP BY 1), s AS (SELECT retriever, query_id, count(*) AS shared FROM al JOIN hy USING (query_id, id) GROUP BY 1, 2)
SELECT retriever, round(avg(100 * coalesce(shared, 0) / n), 1) AS overlap_pct FROM (SELECT * FROM n, (SELECT DISTINCT retriever FROM al)) LEFT JOIN s USING (retriever, query_id) GROUP BY 1""")
def average_overlap(spark, sf_dir):
    corpus, q = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    return R.average_overlap(R.retrieve("hybrid", corpus, q, K), R.compare(["vector", "bm25"], corpus, q, K))


@query(f"""
WITH {_BM25}, top AS (SELECT query_id, id, rank, text FROM br JOIN documents ON doc_id = id WHERE rank <= 3),
cx AS (SELECT query_id, list_distinct({tokens_sql("string_agg(text, chr(10) || chr(10) ORDER BY rank)")}) AS d, list_distinct({tokens_sql("max(text) FILTER (WHERE rank = 1)")}) AS a FROM top GROUP BY 1),
fa AS (SELECT item_id AS query_id, list_distinct({tokens_sql('f')}) AS w FROM (SELECT item_id, unnest(list_filter(string_split(text, '. '), lambda x: x <> '')) AS f FROM benchmark)),
ju AS (SELECT query_id, {_containment('w', 'd')} >= 0.5 AS r, {_containment('w', 'a')} >= 0.5 AS g FROM fa JOIN cx USING (query_id)),
co AS (SELECT query_id, {_COUNTS} FROM ju GROUP BY 1),
me AS (SELECT query_id, CASE WHEN bool_or(id % 10 = query_id % 10) THEN 1 ELSE 0 END AS hit, round(coalesce(1.0 / min(rank) FILTER (WHERE id % 10 = query_id % 10), 0), 6) AS mrr FROM top GROUP BY 1)
SELECT co.*, hit, mrr FROM co JOIN me USING (query_id)""")
def retrieval_run(spark, sf_dir):
    """The retrieval-aware run: facts (an item's sentences) in what is retrieved and in the answer (the first document), and ranking metrics."""
    docs, q = _docs(spark, sf_dir), _queries(spark, sf_dir)
    hits = R.bm25_topk(docs, q, 3)
    questions = q.select("query_id", F.filter(F.split("content", r"\. "), lambda x: x != "").alias("key_facts"))
    sizes = q.select("query_id", (F.col("query_id") % 10).alias("d")).join(docs.groupBy((F.col("id") % 10).alias("d")).agg(F.count("*").alias("n_true")), "d").drop("d")
    marked = hits.withColumn("good", F.when(F.col("id") % 10 == F.col("query_id") % 10, 1))
    answers = hits.where("rank = 1").join(docs, "id").select("query_id", F.col("content").alias("answer"))
    return E.retrieval_run(questions, hits, docs, answers, metrics=E.metrics_of(marked, sizes)).drop("recall", "ndcg").withColumn("mrr", F.round("mrr", 6))


@query("""SELECT concat(doc_id, '_chunk_000') AS id, md5(text) AS text, lang AS title, CAST(doc_id AS VARCHAR) AS parent_id, 7 AS n_not_embedded, 3 AS n_not_shown FROM documents""")
def chunk_nodes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.col("lang").alias("title"), *[F.col("source").alias(c) for c in ("source_url", "source_name", "content_type")])
    rows = nodes(docs.withColumns({"chunk_id": F.concat("doc_id", F.lit("_chunk_000")), "chunk_index": F.lit(0), "total_chunks": F.lit(1)}))
    return rows.select("id", F.md5("text").alias("text"), "metadata.title", "parent_id", F.size("excluded_embed_keys").alias("n_not_embedded"), F.size("excluded_llm_keys").alias("n_not_shown"))
