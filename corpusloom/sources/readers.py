"""Readers and writers of documents, chunks, samples and results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import CHUNK, DOCUMENT

#: Between samples of a text file; one constant for writer and reader.
BOUNDARY = "\n<<<SAMPLE_BOUNDARY>>>\n"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file; corpus_file, the file's name, gives the order of the corpus."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("corpus_file", F.col("_metadata.file_name"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of chunks."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def write_chunks(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one array a file: each task writes its rows as they come. ``chunks`` reads them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                out.append(lead + x)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_raw(pages: DataFrame, path: str) -> None:
    """Raw pages (url, html, ...) as they were fetched, added to those there."""
    pages.write.mode("append").parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows written in a program: pasted pages, instruction and refusal samples."""
    return spark.createDataFrame(rows, schema)


def write_audit(report: DataFrame, path: str, run: str) -> None:
    """An audit's entries with their issues as JSON, under their run."""
    report.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").json(path)


def parents(docs: DataFrame) -> DataFrame:
    """Documents by key, as chunks' parents: doc_id, title, source_url, content, of repeated keys the one scraped last."""
    return docs.groupBy("doc_id").agg(F.max_by(F.struct("title", "source_url", "content"), F.struct("scraped_at", "content_hash")).alias("d")).select("doc_id", "d.*")


def search_urls(forums: DataFrame, queries: DataFrame, limit: int = 25, base: str = "https://www.reddit.com") -> DataFrame:
    """url of each forum's search for each query (both short lists), as ``web_pages`` fetches and ``posts`` parses them. forums: forum; queries: query."""
    pairs = forums.crossJoin(F.broadcast(queries))
    return pairs.select(F.concat(F.lit(f"{base}/r/"), "forum", F.lit("/search.json?q="), F.url_encode("query"), F.lit(f"&restrict_sr=on&sort=relevance&t=all&limit={limit}")).alias("url"))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """content of each sample between boundaries; blank ones go."""
    rows = spark.read.text(path, lineSep=BOUNDARY).select(F.trim("value").alias("content"))
    return rows.where("content <> ''")


def write_samples(rows: DataFrame, path: str, content: str = "content") -> None:
    rows.select(F.col(content).alias("value")).write.mode("overwrite").text(path, lineSep=BOUNDARY)


def is_chatml(rows: DataFrame) -> bool:
    """Whether the first sample has the marks of a chat turn."""
    first = rows.head(1)
    return bool(first) and "<|im_start|>" in first[0]["content"]


def new_results(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Result rows from files whose path is not in known (path)."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.join(known.select("path").distinct(), "path", "left_anti")


def write_results(rows: DataFrame, path: str, run: str) -> None:
    """Scored rows without the retrieved context, under their run."""
    rows.drop("retrieved_context").withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").json(path)


def posts(raw: DataFrame) -> DataFrame:
    """id, subreddit, title, selftext (2,000 characters), url, score, num_comments, created of posts in a listing's JSON (column value)."""
    post = "struct<id:string,subreddit:string,title:string,selftext:string,permalink:string,score:int,num_comments:int,created_utc:double,link_flair_text:string>"
    listing = F.from_json("value", f"data struct<children:array<struct<kind:string,data:{post}>>>")
    rows = raw.select(F.explode(F.filter(listing["data"]["children"], lambda x: x["kind"] == "t3")).alias("p")).select("p.data.*")
    return rows.select("id", "subreddit", "title", F.substring(F.coalesce("selftext", F.lit("")), 1, 2000).alias("selftext"), F.concat(F.lit("https://www.reddit.com"), F.col("permalink")).alias("url"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"), F.timestamp_seconds("created_utc").alias("created"), "link_flair_text")
