"""Helpers shared by the operators: stored intermediate tables, batches, input tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship

#: Text bytes that one numpy pass works on; a longer single text makes a pass of its own.
SLICE_BYTES = 1_000_000
#: Rows and bytes of an Arrow batch where the session has Spark's defaults: texts are long, and a batch is held several times over.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from spark.checkpoint.dir; a temporary one in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH does not already hold it, and keep Arrow batches small."""
    for name, (default, own) in _BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
    ship(spark)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage ends there, so a lost executor costs one stage.

    Results read some of these tables, so those stay until the session ends, when whatever is left is deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._keep: list[DataFrame] = []  # ids stay unique while the frames live
        ship_package(spark)
        atexit.register(self.clear)  # the gateway to the JVM closes after what was registered later

    def store(self, df: DataFrame, name: str, **options: str | int) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *frames: DataFrame) -> None:
        """Delete stored tables that nothing reads any more."""
        for df in frames:
            if path := self.paths.get(id(df)):
                self._delete(path)

    def clear(self) -> None:
        """Delete all tables stored here; the caller has what it needs of them, or the session ends."""
        with contextlib.suppress(Exception):  # a session that has stopped already leaves its folder to its owner
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give what a task has freed back to the system: workers are kept for the next task, and so is their memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each, or a single row."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = SLICE_BYTES, column: int = 1) -> DataFrame:
    """mapInArrow over bounded slices; ``column`` is the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_digest(text: str = "text") -> Column:
    """The MD5 of a text as 16 bytes, null like empty: with doc_id it tells rows of one doc_id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


#: Buckets that keys are hashed to; the list of those that a table of keys occupies is broadcast.
KEY_BUCKETS = 1 << 20


def parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, apart): the rows whose key (_doc, _t) may be in keys, and those whose key surely is not.

    At most KEY_BUCKETS occupied buckets are broadcast, whatever the size of keys. Rows apart need no join, so their texts are not shuffled.
    """
    bucket = F.pmod(F.xxhash64("_doc", "_t"), F.lit(KEY_BUCKETS))
    known = keys.select(bucket.alias("_bucket")).distinct().withColumn("_met", F.lit(True))
    marked = rows.withColumn("_bucket", bucket).join(F.broadcast(known), "_bucket", "left").drop("_bucket")
    return marked.where("_met").drop("_met"), marked.where("_met is null").drop("_met")


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_one(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the rows of docs in each part the one of least doc_id, then least digest; rows without doc_id all stay.

    rows: doc_id, t (``text_digest``), part of every row of docs. Rows alike in doc_id and text stay once.
    """
    known = rows.where("doc_id is not null")
    best = known.groupBy("part").agg(F.min(F.struct("doc_id", "t")).alias("best"))
    each = known.groupBy("doc_id", "t", "part").agg(F.count("*").alias("n"))
    fate = F.when(F.struct("doc_id", "t") != F.col("best"), "goes").when(F.col("n") > 1, "once")
    fates = scratch.store(each.join(best, "part").select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), fate.alias("fate")).where("fate is not null"), "fates")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_digest().alias("_t"))
    met, apart = parted(whole, fates)
    met = met.join(fates, ["_doc", "_t"], "left")
    kept = apart.select("row").unionByName(met.where("fate is null").select("row"))
    if not fates.where("fate = 'once'").isEmpty():
        kept = kept.unionByName(met.where("fate = 'once'").groupBy("_doc", "_t").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return kept.select("row.*")
