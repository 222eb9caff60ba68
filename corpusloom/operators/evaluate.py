"""Evaluation: ranking metrics, claim attribution, runs compared, audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import containment, without_source_note


def ranking_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, mrr, hit, recall, ndcg. results: query_id, id, rank; truth: query_id, id. Queries without results score 0.

    The ideal gain has as many places as there are true ids, but no more than results.
    """
    true = truth.select("query_id", "id").distinct()
    sizes = true.groupBy("query_id").agg(F.count("*").alias("n_true"))
    return metrics_of(results.join(true.withColumn("good", F.lit(1)), ["query_id", "id"], "left"), sizes)


def metrics_of(marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from results whose ``good`` is 1 where the id is true, and sizes (query_id, n_true), where the true ids need not be listed."""
    discount = F.when(F.col("good") == 1, 1 / F.log2(F.col("rank") + 1))
    found = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.count("good").alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.coalesce(F.sum(discount), F.lit(0.0)).alias("dcg"))
    joined = sizes.join(found, "query_id", "left").withColumn("ideal", F.least("n_true", F.coalesce("n", F.lit(0))).cast("int"))
    idcg = F.when(F.col("ideal") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("ideal", F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
    return joined.select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("hit"), (F.coalesce("hits", F.lit(0)) / F.col("n_true")).alias("recall"), F.coalesce(F.col("dcg") / idcg, F.lit(0.0)).alias("ndcg"))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(m), 4).alias(m) for m in ("mrr", "hit", "recall", "ndcg")], F.count("*").alias("n_queries"))


def attribution(in_retrieval: Column, in_generation: Column) -> Column:
    return F.when(in_retrieval & in_generation, "covered").when(in_retrieval, "generation_miss").when(in_generation, "hallucinated").otherwise("retrieval_miss")


def attribution_counts(facts: DataFrame, *by: str) -> DataFrame:
    """Counts of the four kinds, coverages and shares of misses. facts: in_retrieval, in_generation."""
    kinds = facts.withColumn("kind", attribution(F.col("in_retrieval"), F.col("in_generation")))
    n = {k: F.count_if(F.col("kind") == k) for k in ("covered", "generation_miss", "retrieval_miss", "hallucinated")}
    counted = kinds.groupBy(*by).agg(*[v.alias(k) for k, v in n.items()], F.count("*").alias("facts"))
    c, g, r, h = (F.col(k) for k in n)
    share = lambda x, of: F.when(of > 0, F.round(x / of, 4)).otherwise(0.0)
    return counted.select(*by, *n, "facts", share(c + g, F.col("facts")).alias("retrieval_coverage"), share(c + h, F.col("facts")).alias("generation_coverage"), share(c, c + g).alias("generation_given_retrieval"), share(g, g + r).alias("generation_miss_share"))


def by_tier(facts: DataFrame, tier: str = "tier") -> DataFrame:
    """tier, facts, retrieved, generation_coverage of each tier and, under "overall", of all. facts: the tier, in_retrieval, in_generation."""
    sums = [F.count("*").alias("facts"), F.count_if("in_retrieval").alias("retrieved"), F.round(F.avg(F.col("in_generation").cast("int")), 4).alias("generation_coverage")]
    return facts.groupingSets([[tier], []], F.col(tier)).agg(*sums).withColumn(tier, F.coalesce(tier, F.lit("overall")))


def valid(score: Column) -> Column:
    """A score, or null where it stands for a judge that failed (below 0)."""
    return F.when(score >= 0, score)


def summary(rows: DataFrame, by: str) -> DataFrame:
    """Valid rows, mean scores and claim recall over all facts; a group without valid rows counts all of its rows.

    rows: faithfulness, relevancy, correctness (null where a judge failed), hits, facts.
    """
    valid = F.col("faithfulness").isNotNull()
    judged = valid & F.col("correctness").isNotNull()
    n = F.count_if(valid)
    means = [F.round(F.avg(F.when(valid, F.col(c))), 3).alias(f"{c}_mean") for c in ("faithfulness", "relevancy")]
    facts = F.sum(F.when(judged, F.col("facts")))
    return rows.groupBy(by).agg(F.when(n > 0, n).otherwise(F.count("*")).alias("n"), *means, F.round(F.avg(F.when(judged, F.col("correctness"))), 3).alias("correctness_mean"), F.when(facts > 0, F.round(F.sum(F.when(judged, F.col("hits"))) / facts, 3)).alias("claim_recall"))


def run_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample deviation (0 of one run) and 95 % interval of ``value`` over the rows of each group."""
    v = F.col(value)
    agg = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("s") / F.sqrt("n")).otherwise(0.0)
    return agg.where("n > 0").select(*by, "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("std"), F.round(F.col("m") - half, 4).alias("ci_95_low"), F.round(F.col("m") + half, 4).alias("ci_95_high"))


def majority(votes: DataFrame, label: str, order: str, *by: str) -> DataFrame:
    """The most frequent label of each group; of equals the one seen first."""
    counted = votes.groupBy(*by, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("votes"))


def runs(n: int, make: Callable[[int], DataFrame], run: str = "run") -> DataFrame:
    """The rows of n runs with their number, as ``question_runs`` and ``run_aggregates`` take them."""
    return reduce(DataFrame.unionByName, [make(i).withColumn(run, F.lit(i)) for i in range(n)])


def run_aggregates(facts: DataFrame, run: str = "run", *, key: str = "metric") -> DataFrame:
    """metric, n, mean, std, ci_95_low, ci_95_high over runs: of each run's attribution counts and coverages. facts: run, in_retrieval, in_generation."""
    return over_runs(attribution_counts(facts, run), run, key)


def over_runs(each: DataFrame, run: str = "run", key: str = "metric") -> DataFrame:
    """``run_aggregates`` from each run's attribution counts, which may have been kept from before."""
    names = ["retrieval_coverage", "generation_coverage", "generation_given_retrieval", "covered", "generation_miss", "retrieval_miss", "hallucinated"]
    return run_stats(each.unpivot([run], names, key, "value").withColumn("value", F.col("value").cast("double")), "value", key)


def question_runs(rows: DataFrame, most: float = 0.1) -> DataFrame:
    """question_id, runs, mean and deviation of both scores over runs, unstable, in the order of the greater deviation, greatest first.

    rows: run, question_id, retrieval_coverage, generation_correctness. A question is unstable if a rounded deviation is over ``most``.
    """
    spread = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4)
    scores = {"retrieval": "retrieval_coverage", "generation": "generation_correctness"}
    found = rows.groupBy("question_id").agg(F.count("*").alias("runs"), *[f for k, c in scores.items() for f in (F.round(F.avg(c), 4).alias(f"{k}_mean"), spread(c).alias(f"{k}_std"))])
    widest = F.greatest("retrieval_std", "generation_std")
    return found.withColumn("unstable", widest > most).orderBy(widest.desc(), "question_id")


def prefix_scores(rows: DataFrame, key: str = "question_id", value: str = "faithfulness", passing: float = 1.0) -> DataFrame:
    """prefix (of the id, before the first underscore), n, mean, passed: rows with a valid score by where their question comes from."""
    valid = rows.where(F.col(value).isNotNull())
    return valid.groupBy(F.substring_index(F.col(key), "_", 1).alias("prefix")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.count_if(F.col(value) == passing).alias("passed"))


def zipped_facts(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each fact with its place and its verdicts in both judgements. rows: facts, in_retrieval, in_generation (arrays alike in order)."""
    zipped = rows.select(*keep, F.posexplode(F.arrays_zip("facts", "in_retrieval", "in_generation")).alias("fact_index", "z"))
    return zipped.select(*keep, "fact_index", F.col("z.facts").alias("fact"), *[F.coalesce(f"z.{c}", F.lit(False)).alias(c) for c in ("in_retrieval", "in_generation")])


def has_any(c: Column) -> Column:
    """Whether an array is there and not empty: key facts or source chunks that a check can use."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def retrieval_run(questions: DataFrame, results: DataFrame, chunks: DataFrame, answers: DataFrame, score: Callable[[Column, Column], Column] = containment, least: float = 0.5, metrics: DataFrame | None = None) -> DataFrame:
    """A row for each question with key facts: coverages by retrieval and generation, facts, and ranking metrics of its results.

    questions: query_id, key_facts, source_ids (the true ids); results: query_id, id, rank; chunks: id, content; answers: query_id, answer.
    A fact is in a text where its score against it is at least ``least``. Where true ids are too many to be listed, ``metrics`` (of ``metrics_of``) stand for them. Questions without results retrieve nothing.
    """
    judged = questions.where(has_any(F.col("key_facts")))
    parts = results.join(chunks.select("id", "content"), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("p"))  # top-k rows a query
    context = parts.select("query_id", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("context"))
    facts = judged.select("query_id", F.explode("key_facts").alias("fact")).join(context, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    within = lambda c: score(F.col("fact"), F.coalesce(c, F.lit(""))) >= least
    covered = attribution_counts(facts.select("query_id", within("context").alias("in_retrieval"), within("answer").alias("in_generation")), "query_id")
    if metrics is None:
        metrics = ranking_metrics(results, judged.select("query_id", F.explode("source_ids").alias("id")))
    return covered.join(metrics, "query_id", "left")


def against_baseline(rows: DataFrame, config: str, baseline: str, key: str, value: str, least: float = 0.001) -> DataFrame:
    """Delta of each key and configuration to the baseline configuration, and whether it improved."""
    base = rows.where(F.col(config) == baseline).select(key, F.col(value).alias("base"))
    delta = F.round(F.col(value) - F.col("base"), 6)
    return rows.where(F.col(config) != baseline).join(base, key).select(config, key, delta.alias("delta"), F.when(delta > least, "improved").when(delta < -least, "regressed").otherwise("same").alias("change"))


def best_configs(rows: DataFrame, topic: str, config: str, value: str, configs: list[str], digits: int = 4) -> DataFrame:
    """A column for each configuration with its mean, the best one (the first of equals) and its lead on the first configuration."""
    wide = rows.groupBy(topic).pivot(config, configs).agg(F.round(F.avg(value), digits))
    place = lambda c: F.struct(F.coalesce(F.col(c), F.lit(-1e18)).alias("v"), F.lit(-configs.index(c)).alias("o"), F.lit(c).alias("c"))
    return wide.withColumn("best", F.greatest(*[place(c) for c in configs]).getField("c")).withColumn("lead", F.round(F.greatest(*[F.col(c) for c in configs]) - F.col(configs[0]), digits))


def audit(entries: DataFrame, chunks: DataFrame, relevance: float = 0.10, grounding: float = 0.15) -> DataFrame:
    """entry_id, check, chunk_id: the issues of entries (id, question, key_facts, source_chunks of chunk_id, title, source_url).

    Missing chunk ids, titles and urls that differ, chunks named twice, chunks with few of the question's words and facts
    with few words in the chunks named.
    """
    named = entries.select(F.col("id").alias("entry_id"), "question", F.explode("source_chunks").alias("s")).select("entry_id", "question", "s.*")
    known = chunks.select("chunk_id", F.col("title").alias("real_title"), F.col("source_url").alias("real_url"), F.col("content").alias("passage"))
    issue = lambda df, name: df.select("entry_id", F.lit(name).alias("check"), "chunk_id")
    met = named.join(known, "chunk_id")
    missing = issue(named.join(known.select("chunk_id"), "chunk_id", "left_anti"), "chunk_id_existence")
    titles = issue(met.where((F.col("title") != "") & (F.col("title") != F.col("real_title"))), "metadata_title_mismatch")
    urls = issue(met.where((F.col("source_url") != "") & (F.col("source_url") != F.col("real_url"))), "metadata_url_mismatch")
    twice = issue(named.groupBy("entry_id", "chunk_id").count().where("count > 1"), "duplicate_chunk_in_entry")
    far = issue(met.where(containment(F.col("question"), F.col("passage")) < relevance), "low_chunk_relevance")
    context = met.groupBy("entry_id").agg(F.array_join(F.collect_list("passage"), " ").alias("context"))  # an entry names few chunks
    facts = entries.select(F.col("id").alias("entry_id"), F.explode("key_facts").alias("fact")).join(context, "entry_id", "left")
    loose = issue(facts.where(containment(without_source_note(F.col("fact")), F.coalesce("context", F.lit(""))) < grounding).withColumn("chunk_id", F.lit(None).cast("string")), "low_fact_grounding")
    return missing.unionByName(titles).unionByName(urls).unionByName(twice).unionByName(far).unionByName(loose)


def audit_summary(issues: DataFrame) -> DataFrame:
    """check, issues, entries: of each check and, under "all", of all of them. issues: entry_id, check."""
    return issues.groupingSets([["check"], []], F.col("check")).agg(F.count("*").alias("issues"), F.countDistinct("entry_id").alias("entries")).withColumn("check", F.coalesce("check", F.lit("all")))


def audit_report(issues: DataFrame, entries: DataFrame, source: str) -> DataFrame:
    """entry_id, source_file, num_issues, issues: a row for each entry, those without issues too, as the report's JSON lists them."""
    own = issues.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("check", "chunk_id"))).alias("issues"))
    rows = entries.select(F.col("id").alias("entry_id")).join(own, "entry_id", "left")
    found = F.coalesce("issues", F.expr("CAST(array() AS array<struct<check:string,chunk_id:string>>)"))
    return rows.select("entry_id", F.lit(source).alias("source_file"), F.size(found).alias("num_issues"), found.alias("issues"))


def repeated_questions(entries: DataFrame, text: Column, order: str, key: str) -> DataFrame:
    """key, first: entries whose question, lower-cased and trimmed, an earlier entry has, with the first such entry."""
    rows = entries.withColumn("_asked", F.lower(F.trim(text)))
    first = rows.groupBy("_asked").agg(F.min(order).alias("_order"), F.min_by(key, order).alias("first"), F.count("*").alias("_n")).where("_n > 1")  # combined on the map side, whatever a question's share
    return rows.join(first.drop("_n"), "_asked").where(F.col(order) > F.col("_order")).select(key, "first")


def first_topic(c: Column, topics: list[tuple[str, list[str]]], default: str) -> Column:
    """The first topic of which any keyword is in the text."""
    out = None
    for name, words in topics:
        hit = F.regexp_like(F.lower(c), F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
