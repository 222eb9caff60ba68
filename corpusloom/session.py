"""Sessions with the settings the engine relies on."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("corpusloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH does not already hold it: once a session, through Spark's file server."""
    root = Path(__file__).resolve().parents[1]
    places = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root) in places or getattr(sc, "_corpusloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves it while the session lives
    target = Path(folder) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "corpusloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._corpusloom_shipped = True


#: Rows and bytes of an Arrow batch where the session has Spark's defaults, for steps whose rows are long: a batch is held several times over.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def small_batches(spark: SparkSession) -> None:
    for name, (default, own) in _BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)


def trim() -> None:
    """Give what a task has freed back to the system: workers are kept for the next task, and so is their memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
