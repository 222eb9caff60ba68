"""Answers from models that are passed in: indexing, asking, judging, and the posts that questions come from.

A model is a function of Columns (a pandas UDF around weights or a service, or an expression). Without one,
deterministic stand-ins keep everything runnable: hashed bags of words embed, the context's first sentence answers,
word containment judges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom.functions.text import chatml, containment, contains_any, rag_system, tokens, unfenced

# Words of posts about housing.
HOUSING = ["landlord", "tenant", "rent", "lease", "evict", "deposit", "apartment", "housing", "repair", "mold", "bed bug", "heat", "utility", "notice", "move out", "security deposit"]
DIMENSIONS = 64


def signed_buckets(text: Column) -> Column:
    """For each word of a text the bucket b of its hash, or -b - 1 where it counts as -1: a hashed bag before it is added up."""

    def bucket(word: Column) -> Column:
        h = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long")
        return F.when(h >= 1 << 31, h % DIMENSIONS).otherwise(-1 - h % DIMENSIONS).cast("int")

    return F.transform(tokens(F.coalesce(text, F.lit(""))), bucket)


def bags(words: pa.Array) -> np.ndarray:
    """Vectors of whole numbers, one for each list of signed buckets."""
    at, offsets = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    at = at[offsets[0] : offsets[-1]].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    sums = np.bincount(owner * DIMENSIONS + np.where(at < 0, -at - 1, at), np.where(at < 0, -1.0, 1.0), len(words) * DIMENSIONS)
    return sums.astype(np.float64).reshape(len(words), DIMENSIONS)  # whole numbers come where there are no words


@F.arrow_udf(ArrayType(DoubleType()))
def _unit_bags(words: pa.Array) -> pa.Array:
    v = bags(words)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    flat = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * DIMENSIONS), pa.array(flat))


def hashed_bag(text: Column) -> Column:
    """A unit vector of hashed words in double precision: the embedding where no model is given. Words are found and hashed in the JVM."""
    return _unit_bags(signed_buckets(F.col(text) if isinstance(text, str) else text))


EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashed_bag": hashed_bag}


def index(chunks: DataFrame, model: str = "hashed_bag") -> DataFrame:
    """chunks (content and further columns) with embedding and the model's name; an unknown model raises."""
    if model not in EMBEDDERS:
        raise ValueError(f"unknown embedding model: {model}")
    return chunks.withColumns({"embedding": EMBEDDERS[model](F.col("content")), "model": F.lit(model)})


def build_index(chunks: DataFrame, path: str, model: str = "hashed_bag") -> None:
    """Drop and write anew, a folder for each model."""
    index(chunks, model).write.mode("overwrite").partitionBy("model").parquet(path)


def first_sentence(question: Column, context: Column) -> Column:
    """The first sentence of the first source, which ends where the next one is named; blank where that has no end of a sentence."""
    own = F.split(F.regexp_replace(context, r"^\[Source[^\n]*\n", ""), r"\n\n---\n\n\[Source \d+: ", 2)[0]
    return F.coalesce(F.regexp_extract(own, r"^([^.!?]*[.!?])", 1), F.lit(""))


def context_of(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context, footer: numbered sources with their texts, and the distinct sources. chunks: id, title, source_url, content."""
    rows = results.join(chunks.select("id", "title", "source_url", "content"), "id")
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), "title", F.lit(" ("), "source_url", F.lit(")]\n"), "content")
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "source_url", F.lit(")"))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), line.alias("line")))).alias("p"))  # top-k rows a query
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n---\n\n").alias("context"), F.concat(F.lit("\n\n---\n**Sources:**\n"), F.array_join(F.array_distinct(F.transform("p", lambda x: x["line"])), "\n")).alias("footer"))


def ask(queries: DataFrame, results: DataFrame, chunks: DataFrame, generate: Callable[[Column, Column], Column] = first_sentence) -> DataFrame:
    """query_id, question, answer with its footer, context. queries: query_id, content."""
    asked = queries.select("query_id", F.col("content").alias("question")).join(context_of(results, chunks), "query_id", "left")
    answer = generate(F.col("question"), F.coalesce("context", F.lit("")))
    return asked.select("query_id", "question", F.concat(answer, F.coalesce("footer", F.lit(""))).alias("answer"), "context")


def grid(questions: DataFrame, configurations: list[tuple[str, str, bool]]) -> DataFrame:
    """Every question with every configuration (name, retriever, whether context is used); the list is short."""
    configs = questions.sparkSession.createDataFrame(configurations, "configuration string, retriever string, use_rag boolean")
    return questions.crossJoin(F.broadcast(configs))


def judge(rows: DataFrame, score: Callable[[Column, Column], Column] = containment, least: float = 0.5) -> DataFrame:
    """rows (question, answer, context, key_facts) with faithfulness, relevancy, correctness, hits, facts; null where there is nothing to judge."""
    facts = F.coalesce("key_facts", F.array().cast("array<string>"))
    n = F.size(facts)
    exploded = F.filter(facts, lambda f: score(f, F.col("answer")) >= least)
    return rows.withColumns({"faithfulness": F.when(F.col("context").isNotNull(), score(F.col("answer"), F.col("context"))), "relevancy": score(F.col("question"), F.col("answer")), "hits": F.size(exploded), "facts": n, "correctness": F.when(n > 0, F.round(F.size(exploded) / n, 3))})


def score_all(rows: DataFrame, questions: DataFrame, score: Callable[[Column, Column], Column] = containment, least: float = 0.5) -> DataFrame:
    """rows (question_id, question, answer, context) with their questions' key facts, and judged; a question that is not known has none. questions: id, key_facts."""
    known = questions.select(F.col("id").alias("question_id"), "key_facts").dropDuplicates(["question_id"])
    return judge(rows.join(known, "question_id", "left"), score, least)


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for rerankers and judges around a model of pairs of texts: ``load`` runs once for a worker's task, its result on whole batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for a, b in batches:
            yield pd.Series(predict(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype="float64")

    return run


def relevant_posts(posts: DataFrame, regions: list[str], local: list[str], n: int, seq: str = "seq") -> DataFrame:
    """The n best-scored of the first 2n posts (by seq) about housing, and about a region unless from a local forum."""
    text = F.lower(F.concat_ws(" ", "title", "selftext"))
    about = contains_any(text, HOUSING) & (F.col("subreddit").isin(local) | contains_any(text, regions) | contains_any(F.lower(F.coalesce("link_flair_text", F.lit(""))), regions))
    return posts.where(about).orderBy(seq).limit(2 * n).orderBy(F.col("score").desc(), seq).limit(n)


def training_set(parts: list[tuple[DataFrame, str, int]], system: str) -> DataFrame:
    """content, source of all samples. parts: rows (question, answer, and context for "rag"), source, weight.

    "instruction" samples have no system turn, "rag" ones carry their context in it.
    """
    made = []
    for rows, source, weight in parts:
        prompt = None if source == "instruction" else rag_system(system, F.col("context"), F.col("question")) if source == "rag" else F.lit(system)
        made.append(rows.select(chatml(F.col("question"), F.col("answer"), prompt).alias("content"), F.lit(source).alias("source"), F.explode(F.sequence(F.lit(1), F.lit(weight))).alias("copy")))
    return reduce(DataFrame.unionByName, made)


def extracted(question: Column, sources: Column) -> Column:
    """The enriching answer where no model is given: the first sentence of the sources, as the fenced JSON that a model returns."""
    said = first_sentence(question, sources)
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(said.alias("answer"), F.array(said).alias("key_facts"))), F.lit("\n```"))


def enriched_posts(posts: DataFrame, results: DataFrame, chunks: DataFrame, generate: Callable[[Column, Column], Column] = extracted, shown: int = 1500) -> DataFrame:
    """posts (query_id, content, ...) with expected_answer, key_facts and source_chunks, from results of a retriever and a model that returns JSON.

    A model sees ``shown`` characters of each source, which is the prompt's own format. Where its answer cannot be parsed, the answer is blank and there are no facts.
    """
    rows = results.join(chunks.select("id", "title", "source_url", "content"), "id")
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), "title", F.lit(" ("), "source_url", F.lit(")]\n"), F.substring("content", 1, shown))
    named = F.struct("rank", part.alias("part"), F.struct(F.col("id").cast("string").alias("chunk_id"), "title", "source_url").alias("chunk"))
    own = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(named)).alias("p"))  # top-k rows a query
    asked = posts.join(own, "query_id", "left").withColumn("_said", generate(F.col("content"), F.coalesce(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n---\n\n"), F.lit(""))))
    parsed = asked.withColumn("_read", F.from_json(unfenced(F.col("_said")), "answer string, key_facts array<string>"))
    none = F.expr("CAST(array() AS array<string>)")
    no_source = F.expr("CAST(array() AS array<struct<chunk_id:string,title:string,source_url:string>>)")
    return parsed.select(*posts.columns, F.coalesce("_read.answer", F.lit("")).alias("expected_answer"), F.coalesce("_read.key_facts", none).alias("key_facts"), F.coalesce(F.transform("p", lambda x: x["chunk"]), no_source).alias("source_chunks"))


def config_row(spark: SparkSession, retrievers: list[str], defaults: dict[str, str]) -> DataFrame:
    """One row: status, the sorted names of retrievers and embedding models, and the defaults."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(sorted(retrievers)).alias("retrievers"), F.lit(sorted(EMBEDDERS)).alias("models"), *[F.lit(v).alias(k) for k, v in sorted(defaults.items())])


def read_index(spark: SparkSession, path: str, model: str = "hashed_bag") -> DataFrame:
    """The rows of an index that a model has made; a model without an index raises."""
    rows = spark.read.parquet(path).where(F.col("model") == model)
    if rows.isEmpty():
        raise ValueError(f"no index of the model: {model}")
    return rows


#: Rows that a report can have.
REPORT_ROWS = 10_000


def report(stats: DataFrame, title: str) -> str:
    """A Markdown table of a small aggregate; one of over REPORT_ROWS rows raises."""
    columns = stats.columns
    rows = stats.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)])
