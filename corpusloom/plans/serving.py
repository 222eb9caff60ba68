"""Queries over answers, judgements, posts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import pages as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import serving as V
from corpusloom.operators import training as N
from corpusloom.plans.base import query, strip_sql, table, tokens_sql
from corpusloom.plans.retrieval import _BM25, _SETS, _containment

#: The nine configurations: no context, and each retriever whose rows are chunks.
CONFIGS = [("baseline", "none", False), *((n, n, True) for n in ("vector", "bm25", "hybrid", "rerank", "parent_child", "multiquery", "hybrid_parent_child", "auto_merge"))]


@query(f"SELECT item_id, configuration, use_rag FROM benchmark CROSS JOIN (VALUES {', '.join(f"('{n}', {str(u).lower()})" for n, _, u in CONFIGS)}) AS c(configuration, use_rag)")
def response_grid(spark, sf_dir):
    return V.grid(table(spark, sf_dir, "benchmark").select("item_id"), CONFIGS).select("item_id", "configuration", "use_rag")


@query(f"""
WITH {_BM25}, top AS (SELECT query_id, rank, source, lang, text FROM br JOIN documents ON doc_id = id WHERE rank <= 3),
c AS (SELECT query_id, regexp_extract(string_agg(text, '' ORDER BY rank) FILTER (WHERE rank = 1), '^([^.!?]*[.!?])', 1) AS said FROM top GROUP BY 1),
f AS (SELECT query_id, string_agg(line, chr(10) ORDER BY first) AS footer FROM (SELECT query_id, concat('- [', lang, '](', source, ')') AS line, min(rank) AS first FROM top GROUP BY 1, 2) GROUP BY 1)
SELECT query_id, md5(concat(said, chr(10), chr(10), '---', chr(10), '**Sources:**', chr(10), footer)) AS answer FROM c JOIN f USING (query_id)""")
def ask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("source_url"), F.col("text").alias("content"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    return V.ask(queries, R.bm25_topk(docs, queries, 3), docs).select("query_id", F.md5("answer").alias("answer"))


@query(f"""
WITH {_BM25}, {_SETS}, top AS (SELECT query_id, rank, source, lang, text FROM br JOIN documents ON doc_id = id WHERE rank <= 3),
c AS (SELECT query_id, regexp_extract(string_agg(text, '' ORDER BY rank) FILTER (WHERE rank = 1), '^([^.!?]*[.!?])', 1) AS said,
  string_agg(concat('[Source ', rank, ': ', lang, ' (', source, ')]', chr(10), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY 1),
f AS (SELECT query_id, string_agg(line, chr(10) ORDER BY first) AS footer FROM (SELECT query_id, concat('- [', lang, '](', source, ')') AS line, min(rank) AS first FROM top GROUP BY 1, 2) GROUP BY 1),
an AS (SELECT query_id, list_distinct({tokens_sql("concat(said, chr(10), chr(10), '---', chr(10), '**Sources:**', chr(10), footer)")}) AS a, list_distinct({tokens_sql('context')}) AS x FROM c JOIN f USING (query_id)),
fa AS (SELECT item_id AS query_id, list_distinct({tokens_sql('f')}) AS fw FROM (SELECT item_id, unnest(string_split(text, '. ')) AS f FROM benchmark)),
hi AS (SELECT query_id, count(*) AS facts, count(*) FILTER (WHERE {_containment('fw', 'a')} >= 0.5) AS hits FROM fa JOIN an USING (query_id) GROUP BY 1)
SELECT query_id, round({_containment('a', 'x')}, 6) AS faithfulness, round({_containment('w', 'a')}, 6) AS relevancy, round(hits / facts, 3) AS correctness, CAST(hits AS INTEGER) AS hits, CAST(facts AS INTEGER) AS facts FROM an JOIN qs USING (query_id) JOIN hi USING (query_id)""")
def judged_answers(spark, sf_dir):
    """All sentences of an item are its facts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("source_url"), F.col("text").alias("content"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    answers = V.ask(queries, R.bm25_topk(docs, queries, 3), docs).withColumn("key_facts", F.split("question", r"\. "))
    return V.judge(answers).select("query_id", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevancy", 6).alias("relevancy"), "correctness", "hits", "facts")


@query(f"""
WITH {_BM25}, top AS (SELECT query_id, id, rank, source, lang, substring(text, 1, 1500) AS t FROM br JOIN documents ON doc_id = id WHERE rank <= 5),
s AS (SELECT query_id, regexp_extract(string_agg(t, '' ORDER BY rank) FILTER (WHERE rank = 1), '^([^.!?]*[.!?])', 1) AS said, string_agg(id, '|' ORDER BY rank) AS chunks FROM top GROUP BY 1)
SELECT query_id, said AS expected_answer, said AS facts, chunks FROM s""")
def enriched_posts(spark, sf_dir):
    """Items as posts, enriched from the five best documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("source_url"), F.col("text").alias("content"))
    posts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    found = V.enriched_posts(posts, R.bm25_topk(docs, posts, 5), docs)
    return found.select("query_id", "expected_answer", F.array_join("key_facts", "|").alias("facts"), F.array_join(F.transform("source_chunks", lambda c: c["chunk_id"]), "|").alias("chunks"))


@query(f"""
WITH r AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, lead(text, 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, list_distinct({tokens_sql('q')}) AS w, list_distinct({tokens_sql('a')}) AS d, list_distinct({tokens_sql('c')}) AS x, ['heat', 'rent', 'the'] AS fs FROM r WHERE a IS NOT NULL),
j AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN len(list_filter(['heat', 'rent'], lambda f: list_contains(d, f))) ELSE 0 END AS hits, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END AS facts FROM s)
SELECT conv_id, turn, CASE WHEN x IS NOT NULL THEN round({_containment('d', 'x')}, 6) END AS faithfulness, round({_containment('w', 'd')}, 6) AS relevancy, CAST(hits AS INTEGER) AS hits, CAST(facts AS INTEGER) AS facts, CASE WHEN facts > 0 THEN round(hits / facts, 3) END AS correctness FROM j""")
def score_all(spark, sf_dir):
    """Turns as questions, the next ones as answers, those after them as contexts; every second conversation has facts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(w), "context": F.lead("text", 2).over(w)}).where("answer is not null")
    questions = turns.where("conv_id % 2 = 0").select(F.col("conv_id").alias("id"), F.array(F.lit("heat"), F.lit("rent")).alias("key_facts"))
    found = V.score_all(turns.select(F.col("conv_id").alias("question_id"), "turn", F.col("text").alias("question"), "answer", "context"), questions)
    return found.select(F.col("question_id").alias("conv_id"), "turn", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevancy", 6).alias("relevancy"), "hits", "facts", "correctness")


@query("SELECT 'ok' AS status, 10 AS retrievers, 1 AS models, 'rerank' AS retriever, '5' AS top_k")
def engine_config(spark, sf_dir):
    row = V.config_row(spark, list(R.RETRIEVERS), {"retriever": "rerank", "top_k": "5"})
    return row.withColumns({"retrievers": F.size("retrievers"), "models": F.size("models")})


@query(f"""
WITH h AS (SELECT doc_id, unnest(list_transform({tokens_sql("coalesce(text, '')")}, lambda w: CAST(concat('0x', left(md5(w), 8)) AS BIGINT))) AS h FROM documents),
c AS (SELECT doc_id, h % {V.DIMENSIONS} AS b, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS n FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1),
e AS (SELECT d.doc_id, b, CASE WHEN coalesce(norm, 0) > 0 THEN coalesce(c.n, 0) / norm ELSE 0 END AS x FROM documents d CROSS JOIN (SELECT unnest(range({V.DIMENSIONS})) AS b) LEFT JOIN c USING (doc_id, b) LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, 'hashed_bag' AS model, string_agg(CAST(CAST(round(x * 10000) AS INTEGER) AS VARCHAR), ' ' ORDER BY b) AS embedding FROM e GROUP BY 1""")
def embedded_index(spark, sf_dir):
    """Documents with their stand-in embeddings, in ten-thousandths."""
    found = V.index(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))
    return found.select("doc_id", "model", F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("int").cast("string")), " ").alias("embedding"))


@query("""
WITH c AS (SELECT conv_id AS seq, lower(text) AS t, length(text) AS score FROM conversations WHERE turn = 0),
a AS (SELECT seq, score FROM c WHERE (contains(t, 'rent') OR contains(t, 'lease') OR contains(t, 'heat') OR contains(t, 'mold') OR contains(t, 'evict')) AND (seq % 3 = 0 OR seq % 5 = 0 OR seq % 7 = 0) ORDER BY seq LIMIT 40)
SELECT seq, score FROM a ORDER BY score DESC, seq LIMIT 20""")
def relevant_posts(spark, sf_dir):
    """A third of the posts is from a local forum; of the others some name a region in their text or in their flair."""
    k = F.col("conv_id")
    text = F.when(k % 5 == 0, "moved to Boston").otherwise("")
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(k.alias("seq"), F.when(k % 3 == 0, "local").otherwise("legal").alias("subreddit"), F.col("text").alias("title"), text.alias("selftext"), F.length("text").cast("long").alias("score"), F.when(k % 7 == 0, "BOSTON area").alias("link_flair_text"))
    return V.relevant_posts(c, ["boston"], ["local"], 20).select("seq", "score")


_SAID = "'<|im_start|>user', chr(10), " + strip_sql("q") + ", '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), " + strip_sql("a") + ", '<|im_end|>'"


@query(f"""
WITH p AS (SELECT conv_id, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS r, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'golden' WHEN 1 THEN 'instruction' ELSE 'rag' END AS source FROM p WHERE role = 'user' AND r = 'assistant'),
m AS (SELECT source, CASE source WHEN 'golden' THEN concat('<|im_start|>system', chr(10), 'Answer from the sources given.<|im_end|>', chr(10), {_SAID}) WHEN 'instruction' THEN concat({_SAID})
  ELSE concat('<|im_start|>system', chr(10), 'Answer from the sources given.', chr(10), chr(10), 'RETRIEVED CONTEXT:', chr(10), {strip_sql('a')}, chr(10), chr(10), 'QUESTION: ', {strip_sql('q')}, '<|im_end|>', chr(10), {_SAID}) END AS content FROM s)
SELECT source, md5(content) AS content, CAST(unnest(range(1, CASE source WHEN 'golden' THEN 6 WHEN 'rag' THEN 4 ELSE 2 END)) AS INTEGER) AS copy FROM m""")
def training_mix(spark, sf_dir):
    pairs = N.dialogue_pairs(table(spark, sf_dir, "conversations")).withColumn("context", F.col("answer"))
    parts = [(pairs.where(F.col("conv_id") % 3 == i), source, weight) for i, (source, weight) in enumerate([("golden", 5), ("instruction", 1), ("rag", 3)])]
    return V.training_set(parts, "Answer from the sources given.").select("source", F.md5("content").alias("content"), "copy")


@query("SELECT k FROM range(1, 19) t(k) WHERE k NOT IN (SELECT CAST(r_regionkey AS BIGINT) + 3 FROM region)")
def missing_keys(spark, sf_dir):
    return P.missing_keys(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 3).cast("long").alias("k")), "k", 1, 18)


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'hard' ELSE 'standard' END AS tier FROM benchmark WHERE item_id IN (SELECT n_nationkey FROM nation)")
def fixed_subset(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    tiers = table(spark, sf_dir, "nation").select(k.alias("item_id"), F.when(k % 4 == 0, "hard").otherwise("standard").alias("tier"))
    return N.fixed_set(table(spark, sf_dir, "benchmark"), "item_id", tiers).select("item_id", "tier")
