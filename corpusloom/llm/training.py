"""A bounded sample of labelled rows with their hashed features, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_text


#: Bytes of text that a model is learned from, at most: what reaches the driver is a small multiple of it.
MAX_BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, name: str, most: int, only: str = "true", most_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, y of the rows of at most ``most`` labelled documents with at most ``most_bytes`` of text, chosen by the hash of doc_id.

    ``only`` is an SQL condition on doc_id. Rows of ``labels`` with a null are left out; where a
    doc_id has several, the largest label counts. A document whose rows don't fit into what is left of the bytes is passed over.
    Since ``most`` bounds the chosen ids, they are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).where(only)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    fits = []
    for r in sorted(sizes.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: (r["h"], r["doc_id"])):  # at most ``most`` rows
        if r["size"] <= most_bytes:
            fits.append((r["doc_id"], r["y"]))
            most_bytes -= r["size"]
    ids = docs.sparkSession.createDataFrame(fits, "doc_id long, y int")
    return rows.join(F.broadcast(ids), "doc_id")


def sample(rows: DataFrame, features: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature ids (uint32) of each row, labels and doc_ids, in the order of a hash of doc_id. rows: doc_id, text, y; bounded."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        ids = pa.array([x.astype(np.uint32).tobytes() for x in features(texts)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], ["doc_id", "y", "ids"])

    got = map_text(rows, run, "doc_id long, y int, ids binary").toArrow()
    doc = got["doc_id"].to_numpy()
    order = np.lexsort((doc, (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
    ids = got["ids"]
    return [np.frombuffer(ids[int(i)].as_py(), np.uint32) for i in order], got["y"].to_numpy()[order].astype(float), doc[order]


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
