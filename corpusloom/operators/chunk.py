"""Chunks and sentences of documents, as table functions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import splitting
from corpusloom.functions.chunking import chunks_of, encoded
from corpusloom.functions.stem import stem
from corpusloom.functions.text import tokens

_STRINGS = ArrayType(StringType())


def _chunks(tokenizer: str):
    @F.pandas_udf(_STRINGS)
    def run(doc_id: pd.Series, kind: pd.Series, text: pd.Series) -> pd.Series:
        tokens = encoded(tokenizer)
        return pd.Series([chunks_of(d or "", k or "guide", t or "", tokens) for d, k, t in zip(doc_id, kind, text, strict=True)])

    return run


@F.pandas_udf(StringType())
def stemmed(term: pd.Series) -> pd.Series:
    """Apply to distinct terms, then join; not to every token."""
    return term.map(stem, na_action="ignore")


@F.arrow_udf(_STRINGS)
def _stems(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    offsets = words.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), stems.take(flat.indices))


def stemmed_tokens(text: Column) -> Column:
    """The stems of a text's lower-cased tokens, in their order. Tokens are found in the JVM, and stemmed once for an Arrow batch."""
    return _stems(tokens(F.coalesce(text, F.lit(""))))


def _exploded(parts: DataFrame, total: str, index: str) -> DataFrame:
    """A row for each of _parts. Counted before, so that rows do not carry the array; an outer explode, as Spark would filter an inner one's input by evaluating the array's expression once more."""
    rows = parts.withColumn(total, F.size("_parts")).select("*", F.posexplode_outer("_parts").alias(index, "content"))
    return rows.where(F.col(index).isNotNull()).drop("_parts").select(*[c for c in parts.columns if c != "_parts"], index, "content", total)


def chunk(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs: doc_id (string), content_type, content and further columns, which come along.

    ``tokenizer`` is the path of a tokenizer's JSON file, on every worker, whose tokens are counted; without one they are estimated and all stays in the JVM.
    """
    if tokenizer:
        parts = docs.withColumn("_parts", _chunks(tokenizer)("doc_id", "content_type", "content")).drop("content")
    else:
        doc, kind, text = (F.coalesce(F.col(c), F.lit(other)) for c, other in (("doc_id", ""), ("content_type", "guide"), ("content", "")))
        pieces = docs.withColumn("_pieces", splitting.pieces_of(doc, kind, text))
        parts = pieces.withColumn("_parts", splitting.chunks_of(doc, text, F.col("_pieces"))).drop("content", "_pieces")
    rows = _exploded(parts, "total_chunks", "chunk_index")
    return rows.withColumn("chunk_id", F.format_string("%s_chunk_%03d", "doc_id", "chunk_index"))


@F.udtf(returnType="chunk_index int, content string")
class ChunkRows:
    """``chunk`` as a table function for SQL: chunk_rows(doc_id, content_type, content)."""

    def eval(self, doc_id: str, kind: str, text: str):
        yield from enumerate(chunks_of(doc_id or "", kind or "guide", text or ""))


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("chunk_rows", ChunkRows)


def sentence_chunks(docs: DataFrame, window: int = 3) -> DataFrame:
    """One row a sentence with its window [window_start, window_end); questions with answers stay whole."""
    split = splitting.with_sentences(docs.where(~F.contains("doc_id", F.lit("faq_full_page"))), "content", "_found")
    whole = F.array(F.coalesce("content", F.lit("")))
    parts = split.withColumn("_parts", F.when(F.col("content_type") == "faq", whole).otherwise(F.col("_found"))).drop("content", "_found")
    rows = _exploded(parts, "total_sentences", "sentence_index")
    i, n = F.col("sentence_index"), F.col("total_sentences")
    return rows.withColumns({"chunk_id": F.format_string("%s_sent_%04d", "doc_id", "sentence_index"), "window_start": F.greatest(F.lit(0), i - window), "window_end": F.least(n, i + window + 1)})


# Metadata that is not embedded, and that which a model is not shown.
NOT_EMBEDDED = ["doc_id", "source_url", "source_name", "title", "content_type", "chunk_index", "total_chunks"]
NOT_SHOWN = ["doc_id", "chunk_index", "total_chunks"]


def nodes(chunks: DataFrame) -> DataFrame:
    """id, text, metadata, parent_id, excluded_embed_keys, excluded_llm_keys: chunks as nodes linked to their documents; the text alone is embedded."""
    keys = lambda names: F.array(*map(F.lit, names))
    return chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), F.struct(*NOT_EMBEDDED).alias("metadata"), F.col("doc_id").alias("parent_id"), keys(NOT_EMBEDDED).alias("excluded_embed_keys"), keys(NOT_SHOWN).alias("excluded_llm_keys"))


def window_text(rows: DataFrame, reach: int, doc: str = "doc_id", order: str = "idx", content: str = "content") -> DataFrame:
    """Each row with the texts of the rows up to ``reach`` before and after it in its document."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("window_text", F.array_join(F.collect_list(content).over(w), " "))


def line_chunks(docs: DataFrame) -> DataFrame:
    """A row for each line: doc_id, chunk_index, content, total_chunks."""
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("parts"))
    return rows.select("doc_id", F.posexplode("parts").alias("chunk_index", "content"), F.size("parts").alias("total_chunks"))


def token_stats(chunks: DataFrame, size: Column, *by: str) -> DataFrame:
    """Least, greatest and whole mean number of tokens, and rows."""
    n = size.alias("n")
    return chunks.select(*by, n).groupBy(*by).agg(F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.floor(F.avg("n")).cast("long").alias("avg_tokens"), F.count("*").alias("n_chunks"))
