"""A stream sink for chat events: server-sent text in files, committed batch by batch.

A task writes its rows to a file of its own; a batch counts once its list of files is there, under the batch's number. A batch that Spark
runs again, after a failure between the commit and the checkpoint, finds its list and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FORMAT = "corpusloom_chat"
_BATCHES, _FILES = "batches", "files"


def _place(path: str):
    """A file system and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class ChatWriter(DataSourceStreamWriter):
    """Rows of chat_id, seq, event, data."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        lines = [json.dumps([r["chat_id"], r["seq"], r["event"], r["data"]]) for r in iterator]  # the events of a task's share of one batch
        if not lines:
            return Written(None, 0)
        store, base = _place(self.path)
        name = f"{uuid.uuid4().hex}.jsonl"
        store.create_dir(f"{base}/{_FILES}", recursive=True)
        with store.open_output_stream(f"{base}/{_FILES}/{name}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Written(name, len(lines))

    def commit(self, messages, batchId: int) -> None:  # noqa: N803 (Spark's name)
        from pyarrow import fs

        store, base = _place(self.path)
        done = f"{base}/{_BATCHES}/{batchId:09d}.json"
        if store.get_file_info(done).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        store.create_dir(f"{base}/{_BATCHES}", recursive=True)
        with store.open_output_stream(f"{done}.part") as out:
            out.write(json.dumps({"batch": batchId, "files": [m.file for m in messages if m and m.file]}).encode())
        store.move(f"{done}.part", done)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._drop(messages)

    def _drop(self, messages) -> None:
        store, base = _place(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{base}/{_FILES}/{m.file}")


class ChatSink(DataSource):
    """writeStream.format("corpusloom_chat").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> ChatWriter:  # noqa: N802 (Spark's name)
        if "path" not in self.options:
            raise ValueError("the chat sink needs a path")
        return ChatWriter(self.options["path"].rstrip("/"))


def write_chats(events: DataFrame, path: str, checkpoint: str):
    """Start a query that writes a stream of chat events to ``path``."""
    events.sparkSession.dataSource.register(ChatSink)
    return events.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).start()


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """batch, chat_id, seq, event, data of the batches that are committed."""
    lists = spark.read.schema("batch long, files array<string>").json(f"{path}/{_BATCHES}/*.json").select("batch", F.explode("files").alias("file"))
    rows = spark.read.text(f"{path}/{_FILES}").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    parsed = rows.select("file", F.from_json("value", "array<string>").alias("v")).select("file", F.col("v")[0].cast("long").alias("chat_id"), F.col("v")[1].cast("int").alias("seq"), F.col("v")[2].alias("event"), F.col("v")[3].alias("data"))
    return parsed.join(F.broadcast(lists), "file").drop("file")
