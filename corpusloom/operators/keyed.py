"""A stored table with one row for each key, of which an update rewrites the buckets of its keys alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.pages import replace_by_key, upsert
from corpusloom.storage import delete, new_folder

BUCKETS = 64
_BUCKET = "_bucket"


@dataclass
class KeyedTable:
    """Rows in folders by a hash of ``key``. The schema is fixed; buckets do not change once there are rows."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int = BUCKETS

    @property
    def rows(self) -> DataFrame:
        return self._stored().drop(_BUCKET)

    def _stored(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{self.schema}, {_BUCKET} int")
        return self.spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(self.path)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _put(self, new: DataFrame, merge) -> None:
        """Old rows of the buckets that new rows fall into, merged with these, in place of what the buckets held.

        The merged rows are written aside first: buckets are read before any is replaced, and a replacement that fails half-way can be done again.
        """
        fresh = self._bucket(new.select(*[f"`{c}`" for c in self._stored().drop(_BUCKET).columns]))
        touched = sorted(r[_BUCKET] for r in fresh.select(_BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        old = self._stored().where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
        aside = new_folder(self.spark, "keyed")
        self._bucket(merge(old, fresh.drop(_BUCKET))).repartition(_BUCKET).write.parquet(aside)
        staged = self.spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(aside)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        delete(self.spark, aside)

    def upsert(self, new: DataFrame, newest: str) -> None:
        """One row for each key, the one of greatest ``newest``: see ``pages.upsert`` for ties. A null key is a key."""
        self._put(new, lambda old, own: upsert(old, own, self.key, newest))

    def replace(self, new: DataFrame) -> None:
        """The new rows in place of all old ones of their keys, as ``pages.replace_by_key``."""
        self._put(new, lambda old, own: replace_by_key(old, own, self.key))
