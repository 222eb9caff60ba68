"""Results of runs as they arrive: files are read once, each run's counts are kept as state.

The counts of all runs are written after each batch, a folder a batch, so that a batch that Spark runs again writes the same folder
again; statistics over runs come from the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.evaluate import attribution_counts, over_runs
from corpusloom.storage import delete

FACTS = "run int, in_retrieval boolean, in_generation boolean"
#: Folders of counts that stay: the latest, and the one before for who still reads it.
KEPT = 2


def fact_stream(spark: SparkSession, path: str, schema: str = FACTS) -> DataFrame:
    """Judged facts from files of JSON arrays in a folder, each file once."""
    return spark.readStream.schema(schema).option("multiLine", True).json(path)


def _batches(spark: SparkSession, path: str) -> list[int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in store.listStatus(where)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and store.exists(done(f"{path}/{n}/_SUCCESS")))


def keep_counts(facts: DataFrame, path: str, checkpoint: str, run: str = "run"):
    """Start a query that keeps each run's attribution counts under ``path``, whatever files its facts come in."""

    def put(counts: DataFrame, batch: int) -> None:
        spark = counts.sparkSession
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        for old in _batches(spark, path)[:-KEPT]:
            delete(spark, f"{path}/batch={old}")

    return attribution_counts(facts, run).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def kept_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """Each run's counts after the latest batch, None before the first."""
    done = _batches(spark, path)
    return spark.read.parquet(f"{path}/batch={done[-1]}") if done else None


def kept_aggregates(spark: SparkSession, path: str, run: str = "run") -> DataFrame | None:
    """``run_aggregates`` of all facts so far."""
    counts = kept_counts(spark, path)
    return None if counts is None else over_runs(counts.withColumn(run, F.col(run)), run)
