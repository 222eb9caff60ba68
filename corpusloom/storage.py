"""Folders that the driver and all executors share, for tables that outlive a query's plan."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there is deleted when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):  # a session that has stopped leaves its folder to its owner
            if spark.sparkContext._jsc is not None:
                delete(spark, path)

    atexit.register(clear)
    return path
