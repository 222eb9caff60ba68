"""Queries over evaluation, audits and training sets. Events stand for scored runs: user as question, type as configuration, day as run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import chatml
from corpusloom.operators import evaluate as E
from corpusloom.operators import training as N
from corpusloom.operators.retrieval import ranked
from corpusloom.plans.base import collapse_sql, query, strip_sql, table

CONFIGS = ["view", "click", "purchase", "error"]


@query("""
SELECT source, CASE WHEN count(quality) > 0 THEN count(quality) ELSE count(*) END AS n, round(avg(quality), 3) AS faithfulness_mean, round(avg(CASE WHEN quality IS NOT NULL THEN toxic END), 3) AS relevancy_mean,
       round(avg(CASE WHEN quality IS NOT NULL THEN n_chars % 2 END), 3) AS correctness_mean, round(sum(CASE WHEN quality IS NOT NULL THEN n_chars % 5 END) / sum(CASE WHEN quality IS NOT NULL THEN 5 END), 3) AS claim_recall
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def quality_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("source", F.col("quality").alias("faithfulness"), F.col("toxic").alias("relevancy"), (F.col("n_chars") % 2).alias("correctness"), (F.col("n_chars") % 5).alias("hits"), F.lit(5).alias("facts"))
    return E.summary(rows, "source")


_FACTS = """f AS (SELECT l_orderkey AS q, CASE WHEN l_orderkey % 3 = 0 THEN 'hard' ELSE 'standard' END AS tier, l_quantity > 15 AS r, l_discount > 0.04 AS g FROM lineitem)"""
_COUNTS = """count(*) FILTER (WHERE r AND g) AS covered, count(*) FILTER (WHERE r AND NOT g) AS generation_miss, count(*) FILTER (WHERE NOT r AND NOT g) AS retrieval_miss, count(*) FILTER (WHERE NOT r AND g) AS hallucinated, count(*) AS facts,
round(count(*) FILTER (WHERE r) / count(*), 4) AS retrieval_coverage, round(count(*) FILTER (WHERE g) / count(*), 4) AS generation_coverage,
CASE WHEN count(*) FILTER (WHERE r) > 0 THEN round(count(*) FILTER (WHERE r AND g) / count(*) FILTER (WHERE r), 4) ELSE 0.0 END AS generation_given_retrieval,
CASE WHEN count(*) FILTER (WHERE NOT g) > 0 THEN round(count(*) FILTER (WHERE r AND NOT g) / count(*) FILTER (WHERE NOT g), 4) ELSE 0.0 END AS generation_miss_share"""


def _facts(spark, sf_dir):
    tier = F.when(F.col("l_orderkey") % 3 == 0, "hard").otherwise("standard")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), tier.alias("tier"), (F.col("l_quantity") > 15).alias("in_retrieval"), (F.col("l_discount") > 0.04).alias("in_generation"))


@query(f"WITH {_FACTS} SELECT q, {_COUNTS} FROM f GROUP BY q")
def attribution_counts(spark, sf_dir):
    return E.attribution_counts(_facts(spark, sf_dir), "q")


@query(f"WITH {_FACTS} SELECT coalesce(tier, 'overall') AS tier, count(*) AS facts, count(*) FILTER (WHERE r) AS retrieved, round(avg(CASE WHEN g THEN 1 ELSE 0 END), 4) AS generation_coverage FROM f GROUP BY GROUPING SETS ((tier), ())")
def tier_grouping_sets(spark, sf_dir):
    return E.by_tier(_facts(spark, sf_dir))


_STATS = "count(*) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(avg(v) - CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(v) / sqrt(count(*)) ELSE 0 END, 4) AS ci_95_low, round(avg(v) + CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(v) / sqrt(count(*)) ELSE 0 END, 4) AS ci_95_high"
_METRICS = ["retrieval_coverage", "generation_coverage", "generation_given_retrieval", "covered", "generation_miss", "retrieval_miss", "hallucinated"]


@query(f"""
WITH f AS (SELECT l_linenumber AS run, l_quantity > 15 AS r, l_discount > 0.04 AS g FROM lineitem), c AS (SELECT run, {_COUNTS} FROM f GROUP BY run),
u AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM c" for m in _METRICS)})
SELECT metric, {_STATS} FROM u GROUP BY metric""")
def run_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("run"), (F.col("l_quantity") > 15).alias("in_retrieval"), (F.col("l_discount") > 0.04).alias("in_generation"))
    return E.run_aggregates(rows)


@query("""
WITH r AS (SELECT user_id AS question_id, (event_id % 10) / 10 AS a, (event_id % 7) / 20 AS b FROM events)
SELECT question_id, count(*) AS runs, round(avg(a), 4) AS retrieval_mean, round(coalesce(stddev_samp(a), 0), 4) AS retrieval_std, round(avg(b), 4) AS generation_mean, round(coalesce(stddev_samp(b), 0), 4) AS generation_std,
  greatest(round(coalesce(stddev_samp(a), 0), 4), round(coalesce(stddev_samp(b), 0), 4)) > 0.1 AS unstable FROM r GROUP BY 1""")
def question_runs(spark, sf_dir):
    k = F.col("event_id")
    return E.question_runs(table(spark, sf_dir, "events").select(k.alias("run"), F.col("user_id").alias("question_id"), (k % 10 / 10).alias("retrieval_coverage"), (k % 7 / 20).alias("generation_correctness")))


@query("""SELECT source AS prefix, count(quality) AS n, round(avg(quality), 4) AS mean, count(*) FILTER (WHERE quality = 1) AS passed FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""")
def prefix_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.prefix_scores(rows.select(F.concat("source", F.lit("_q_"), F.col("doc_id").cast("string")).alias("question_id"), F.col("quality").cast("double").alias("faithfulness")))


@query("""
WITH o AS (SELECT o_orderkey AS k FROM orders), z AS (SELECT k, i, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS f FROM o, range(3) t(i))
SELECT k AS o_orderkey, CAST(i AS INTEGER) AS fact_index, concat(f, k) AS fact, k % (i + 2) = 0 AS in_retrieval, CASE WHEN i < 2 THEN k % (i + 3) = 0 ELSE false END AS in_generation FROM z""")
def zipped_facts(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.array(*[F.concat(F.lit(x), k.cast("string")) for x in "abc"]).alias("facts"), F.array(*[k % (i + 2) == 0 for i in range(3)]).alias("in_retrieval"), F.array(*[k % (i + 3) == 0 for i in range(2)]).alias("in_generation"))
    return E.zipped_facts(rows, "o_orderkey")


@query("""
WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY 1)
SELECT event_type, n, round(m, 4) AS mean, round(s, 4) AS std, round(m - 1.96 * s / sqrt(n), 4) AS ci_95_low, round(m + 1.96 * s / sqrt(n), 4) AS ci_95_high FROM a""")
def multirun_stats(spark, sf_dir):
    return E.run_stats(table(spark, sf_dir, "events"), "value", "event_type")


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS majority, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def majority_vote(spark, sf_dir):
    return E.majority(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@query("""
WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, v AS base FROM m WHERE event_type = 'view')
SELECT event_type, user_id, round(v - base, 6) AS delta, CASE WHEN round(v - base, 6) > 0.001 THEN 'improved' WHEN round(v - base, 6) < -0.001 THEN 'regressed' ELSE 'same' END AS change FROM m JOIN b USING (user_id) WHERE event_type <> 'view'""")
def baseline_delta(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return E.against_baseline(means, "event_type", "view", "user_id", "v")


_PIVOT = ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{c}'), 6) AS {c}" for c in CONFIGS)


@query(f"""
WITH w AS (SELECT user_id, {_PIVOT} FROM events GROUP BY 1)
SELECT *, CASE greatest({', '.join(f"coalesce({c}, -1e18)" for c in CONFIGS)}) {' '.join(f"WHEN {c} THEN '{c}'" for c in CONFIGS)} END AS best, round(greatest({', '.join(CONFIGS)}) - view, 6) AS lead FROM w""")
def config_pivot(spark, sf_dir):
    return E.best_configs(table(spark, sf_dir, "events"), "user_id", "event_type", "value", CONFIGS, digits=6)


@query("""
WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS r, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat('<|im_start|>user', chr(10), """ + strip_sql("q") + """, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), """ + strip_sql("a") + """, '<|im_end|>') AS sample FROM p WHERE role = 'user' AND r = 'assistant'""")
def chatml_format(spark, sf_dir):
    pairs = N.dialogue_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", chatml(F.col("question"), F.col("answer")).alias("sample"))


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':42')), doc_id) <= 5""")
def stratified_sample(spark, sf_dir):
    return N.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 5).select("doc_id", "lang")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0 AND n < 7 * 50""")
def systematic_sample(spark, sf_dir):
    return N.systematic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 50)


@query("""SELECT doc_id, CAST(unnest(range(1, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 1 END + 1)) AS INTEGER) AS copy FROM documents""")
def weighted_replication(spark, sf_dir):
    weight = F.when(F.col("lang") == "en", 5).when(F.col("lang") == "fr", 3).when(F.col("lang") == "de", 2).otherwise(1)
    return N.replicate(table(spark, sf_dir, "documents").select("doc_id", "lang"), weight).select("doc_id", "copy")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':42')) DESC) AS n, (SELECT greatest(1, floor(count(*) * 0.1)) FROM documents) AS v FROM documents)
SELECT doc_id, CASE WHEN n <= v THEN 'validation' ELSE 'train' END AS part FROM r""")
def train_val_split(spark, sf_dir):
    return N.split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query(f"""
WITH p AS (SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN 'faq' WHEN 1 THEN 'statute' WHEN 2 THEN 'guide' ELSE 'policy' END AS kind, text FROM documents),
f AS (SELECT * FROM p WHERE length(text) BETWEEN 50 AND 3200 AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) >= 8),
q AS (SELECT doc_id, CASE kind WHEN 'faq' THEN concat('What does ', source, ' say about ', lower(lang), '?') WHEN 'statute' THEN concat('What are the legal requirements under ', lang, '?')
  WHEN 'guide' THEN concat('What guidance does ', source, ' provide about ', lower(lang), '?') ELSE concat('What does Massachusetts law say about ', lower(lang), '?') END AS question, length(text) AS n FROM f)
SELECT doc_id, question FROM q QUALIFY row_number() OVER (PARTITION BY {collapse_sql('lower(question)')} ORDER BY n DESC, doc_id) = 1""")
def longest_answer(spark, sf_dir):
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "faq").when(k == 1, "statute").when(k == 2, "guide").otherwise("policy")
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("content_type"), F.col("source").alias("source_name"), F.col("lang").alias("title"), F.col("text").alias("content"))
    return N.longest_answers(N.chunk_questions(rows).withColumn("answer", F.col("content")), "doc_id").select("doc_id", "question")


@query("""
SELECT event_id, first FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE event_id <> first""")
def duplicate_questions(spark, sf_dir):
    text = F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))
    return E.repeated_questions(table(spark, sf_dir, "events").withColumn("q", text), F.col("q"), "event_id", "event_id")


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licensed|license') THEN 'licence' WHEN regexp_matches(lower(text), '@|token|555-') THEN 'personal' WHEN regexp_matches(lower(text), '!!|###') THEN 'junk' ELSE 'other' END AS topic FROM documents""")
def topic_first_match(spark, sf_dir):
    topics = [("licence", ["licensed", "license"]), ("personal", ["@", "token", "555-"]), ("junk", ["!!", "###"])]
    return table(spark, sf_dir, "documents").select("doc_id", E.first_topic(F.col("text"), topics, "other").alias("topic"))


_AUDIT = """
named AS (SELECT o_orderkey AS e, o_custkey * 2 AS c FROM orders), t AS (SELECT e, c FROM named UNION ALL SELECT o_orderkey, o_custkey * 2 FROM orders WHERE o_orderkey % 10 = 0),
au AS (SELECT CAST(e AS VARCHAR) AS entry_id, 'chunk_id_existence' AS "check", CAST(c AS VARCHAR) AS chunk_id FROM t WHERE c NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT CAST(e AS VARCHAR), 'metadata_title_mismatch', CAST(c AS VARCHAR) FROM t JOIN customer ON c_custkey = c WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT CAST(e AS VARCHAR), 'metadata_url_mismatch', CAST(c AS VARCHAR) FROM t JOIN customer ON c_custkey = c WHERE e % 5 = 1
UNION ALL SELECT CAST(e AS VARCHAR), 'duplicate_chunk_in_entry', CAST(c AS VARCHAR) FROM t GROUP BY e, c HAVING count(*) > 1
UNION ALL SELECT CAST(e AS VARCHAR), 'low_chunk_relevance', CAST(c AS VARCHAR) FROM t JOIN customer ON c_custkey = c WHERE c_nationkey % 2 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'low_fact_grounding', NULL FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 WHERE o_orderkey % 7 = 0 AND coalesce(c_nationkey % 2, 0) = 0)"""


def _entries(spark, sf_dir):
    """Orders as questions that name customers as chunks, some of which are not there, some with other titles and addresses, some with facts."""
    k = F.col("o_orderkey")
    one = F.struct((F.col("o_custkey") * 2).cast("string").alias("chunk_id"), F.lit("BUILDING").alias("title"), F.when(k % 5 == 1, "v").when(k % 5 == 2, "").otherwise("u").alias("source_url"))
    facts = F.when(k % 7 == 0, F.array(F.lit("word1 (Source 2)"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.lit("word1").alias("question"), facts.alias("key_facts"), F.when(k % 10 == 0, F.array(one, one)).otherwise(F.array(one)).alias("source_chunks"))


def _audited(spark, sf_dir):
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_mktsegment").alias("title"), F.lit("u").alias("source_url"), F.concat(F.lit("word"), (F.col("c_nationkey") % 2).cast("string")).alias("content"))
    return E.audit(_entries(spark, sf_dir), chunks)


@query(f"WITH {_AUDIT} SELECT * FROM au")
def contamination_audit(spark, sf_dir):
    return _audited(spark, sf_dir)


@query(f"""WITH {_AUDIT} SELECT coalesce("check", 'all') AS "check", count(*) AS issues, count(DISTINCT entry_id) AS entries FROM au GROUP BY GROUPING SETS (("check"), ())""")
def audit_summary(spark, sf_dir):
    return E.audit_summary(_audited(spark, sf_dir))


@query(f"""WITH {_AUDIT} SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, 'golden' AS source_file, CAST(count(entry_id) AS INTEGER) AS num_issues FROM orders LEFT JOIN au ON entry_id = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey""")
def audit_report(spark, sf_dir):
    return E.audit_report(_audited(spark, sf_dir), _entries(spark, sf_dir), "golden").drop("issues")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_join_missing(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT event_type AS query_id, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 10""")
def topk_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), "event_id", "value")
    return ranked(rows, 10, F.col("value").desc(), F.col("event_id"))


_FIRST = "fi AS (SELECT conv_id, text FROM conversations WHERE turn = 0)"


def _posts(spark, sf_dir):
    """First turns as posts: every second one has an expected answer, every third one an enriched one."""
    k = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    return turns.select(k.alias("id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("context"), F.when(k % 2 == 0, F.concat(F.lit(" e"), k.cast("string"))).otherwise("").alias("expected_answer"), F.when(k % 3 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("enriched_answer"), F.lit("").alias("ideal_answer"), F.when(k % 5 == 0, "last").alias("answer"), F.lit(None).cast("array<string>").alias("key_facts"), F.array().cast("array<struct<chunk_id:string,title:string,source_url:string>>").alias("source_chunks"))


def _golden(spark, sf_dir):
    """Benchmark items as questions with one or two documents as sources; a third of them has key facts in place of an answer."""
    k = F.col("item_id")
    chunk = lambda i: F.struct(i.cast("string").alias("chunk_id"), F.concat(F.lit("t"), i.cast("string")).alias("title"), F.lit("u").alias("source_url"))
    rows = table(spark, sf_dir, "benchmark").select(k.alias("id"), F.col("text").alias("question"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("answer "), k.cast("string"))).alias("expected_answer"), F.when(k % 6 == 0, F.array(F.lit("one"), k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("key_facts"))
    return rows.withColumn("source_chunks", F.when(F.col("id") % 4 == 0, F.array(chunk(F.col("id")), chunk(F.col("id") + 1000000), chunk(F.col("id") + 1))).otherwise(F.array(chunk(F.col("id") * 2))))


@query(f"""
WITH {_FIRST} SELECT concat('reddit_', conv_id) AS id, 'reddit' AS source, text AS question, '' AS context, CASE WHEN conv_id % 2 = 0 THEN concat(' e', conv_id) ELSE '' END AS expected_answer, 0 AS n_facts FROM fi
UNION ALL SELECT CAST(item_id AS VARCHAR), 'golden', text, '', CASE WHEN item_id % 3 = 0 THEN ' ' ELSE concat('answer ', item_id) END, CASE WHEN item_id % 6 = 0 THEN 2 ELSE 0 END FROM benchmark""")
def eval_questions(spark, sf_dir):
    return N.eval_questions(_posts(spark, sf_dir), _golden(spark, sf_dir)).withColumn("n_facts", F.size("key_facts")).drop("key_facts")


@query("""SELECT text AS question, CASE WHEN item_id % 4 = 0 THEN concat(item_id, '|', item_id + 1000000, '|', item_id + 1) ELSE CAST(item_id * 2 AS VARCHAR) END AS ids, CASE WHEN item_id % 4 = 0 THEN concat('t', item_id) ELSE concat('t', item_id * 2) END AS source_title FROM benchmark""")
def retrieval_pairs(spark, sf_dir):
    found = N.retrieval_pairs(_golden(spark, sf_dir), _posts(spark, sf_dir))
    return found.select("question", F.array_join("ground_truth_chunk_ids", "|").alias("ids"), "source_title")


@query(f"""SELECT {strip_sql('text')} AS question, CASE WHEN item_id % 3 = 0 THEN concat('one ', item_id) ELSE concat('answer ', item_id) END AS answer, 'golden' AS source FROM benchmark WHERE {strip_sql('text')} <> '' AND (item_id % 3 <> 0 OR item_id % 6 = 0)""")
def golden_pairs(spark, sf_dir):
    return N.golden_pairs(_golden(spark, sf_dir))


@query(f"""
WITH {_FIRST}, a AS (SELECT {strip_sql('text')} AS question, CASE WHEN conv_id % 2 = 0 THEN concat('e', conv_id) WHEN conv_id % 3 = 0 THEN concat('r', conv_id) WHEN conv_id % 5 = 0 THEN 'last' END AS answer FROM fi)
SELECT question, answer, 'reddit' AS source FROM a WHERE question <> '' AND answer IS NOT NULL""")
def post_pairs(spark, sf_dir):
    return N.post_pairs(_posts(spark, sf_dir))


@query(f"""
WITH n AS (SELECT item_id, unnest(CASE WHEN item_id % 4 = 0 THEN [item_id, item_id + 1000000, item_id + 1] ELSE [item_id * 2] END) AS d, unnest(CASE WHEN item_id % 4 = 0 THEN [1, 2, 3] ELSE [1] END) AS pos FROM benchmark),
c AS (SELECT item_id, string_agg(concat('[Source ', pos, ': ', lang, ' (', source, ')]', chr(10), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM n JOIN documents ON doc_id = d GROUP BY 1)
SELECT {strip_sql('text')} AS question, concat('answer ', item_id) AS answer, md5(context) AS context, 'rag' AS source FROM benchmark JOIN c USING (item_id) WHERE item_id % 3 <> 0 AND {strip_sql('text')} <> ''""")
def grounded_pairs(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("title"), F.col("source").alias("source_url"), F.col("text").alias("content"))
    return N.grounded_pairs(_golden(spark, sf_dir), chunks).withColumn("context", F.md5("context"))


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':42')), doc_id) <= CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 2 ELSE 1 END""")
def topic_quotas(spark, sf_dir):
    return N.topic_quotas(table(spark, sf_dir, "documents"), "lang", "doc_id", {"en": 7, "fr": 2}, 1).select("doc_id", "lang")


@query("""
WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licensed|license') THEN 'licence' ELSE 'other' END AS topic FROM documents),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY md5(concat(doc_id, ':42')), doc_id) <= CASE topic WHEN 'licence' THEN 3 ELSE 5 END)
SELECT concat('golden_', doc_id) AS id, topic, concat('About ', doc_id, '?') AS question, 'yes' AS expected_answer, 'a|b' AS facts, CAST(doc_id AS VARCHAR) AS source FROM p""")
def golden_set(spark, sf_dir):
    """Chunks chosen by topic, questions by a stand-in for the model: JSON within a fence."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("t").alias("title"), F.lit("u").alias("source_url"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("content"))
    model = lambda c: F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("About "), F.split(c, " ")[0], F.lit("?")).alias("question"), F.lit("yes").alias("answer"), F.array(F.lit("a"), F.lit("b")).alias("key_facts"))), F.lit("\n```"))
    found = N.golden_set(chunks, E.first_topic(F.col("content"), [("licence", ["licensed", "license"])], "other"), {"licence": 3}, model, default=5)
    return found.select("id", "topic", "question", "expected_answer", F.array_join("key_facts", "|").alias("facts"), F.col("source_chunks")[0]["chunk_id"].alias("source"))
