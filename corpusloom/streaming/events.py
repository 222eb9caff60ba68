"""Streams: windows and sessions over events, first-seen rows, and the order of a chat's messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events with ts as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values by window and type; the same plan for a table and a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's runs of events with less than ``gap`` between."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(rows: DataFrame, key: Column, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come before within the watermark."""
    return rows.withColumn("_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def chat_events(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """chat_id, seq, event, data of a chat's stream: its sources (contents of 500 characters), its tokens in order, done or error.

    sources: chat_id, rank, title, source_url, content, score; answers: chat_id, answer (null where the model failed).
    """
    listed = sources.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "source_url", "content", "score"))).alias("sources"))
    both = answers.select("chat_id", "answer", F.lit(True).alias("answered")).join(listed, "chat_id", "full_outer")
    return chat_rows(both.withColumn("answered", F.coalesce("answered", F.lit(False))))


def chat_rows(chats: DataFrame) -> DataFrame:
    """``chat_events`` of chats with their sources: chat_id, answered, answer, sources (rank, title, source_url, content, score). No state is needed, so chats may be a stream."""
    source = F.transform("sources", lambda s: F.struct(s["rank"].alias("rank"), s["title"].alias("title"), s["source_url"].alias("source_url"), F.substring(s["content"], 1, 500).alias("content"), s["score"].alias("score")))
    event = lambda seq, name, data: F.struct(seq.cast("int").alias("seq"), F.lit(name).alias("event") if isinstance(name, str) else name.alias("event"), data.alias("data"))
    first = F.when(F.col("sources").isNotNull(), F.array(event(F.lit(0), "sources", F.to_json(source))))
    words = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\S+\s*"), F.lit(0)), lambda w, i: event(i + 1, "token", w))
    last = F.when(F.col("answered"), F.array(event(F.lit(2147483647), F.when(F.col("answer").isNull(), "error").otherwise("done"), F.lit(""))))
    none = F.array().cast("array<struct<seq:int,event:string,data:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in (first, words, last)])
    return chats.select("chat_id", F.explode(every).alias("e")).select("chat_id", "e.seq", "e.event", "e.data")


def sse(events: DataFrame) -> DataFrame:
    """The events as server-sent text: an event line, a data line for each line of the data, a blank line."""
    data = F.array_join(F.transform(F.split("data", "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    return events.select("chat_id", "seq", F.concat(F.lit("event: "), "event", F.lit("\n"), data, F.lit("\n\n")).alias("text"))
