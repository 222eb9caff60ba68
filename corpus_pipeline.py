"""Documents to training sequences in five stages, each written as Parquet and read again.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays, repeated
passages are cut, and what remains is packed. Every stage works on all rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.linededup import line_dedup
from corpusloom.llm.neardup import near_keep
from corpusloom.llm.packing import pack
from corpusloom.llm.suffixes import suffix_dedup
from corpusloom.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(docs, table(spark, sf_dir, "labels"))),
    ("line dedup", lambda spark, docs, sf_dir: line_dedup(docs)),
    ("simhash near-dedup", lambda spark, docs, sf_dir: near_keep(docs)),
    ("suffix-array dedup", lambda spark, docs, sf_dir: suffix_dedup(docs)),
    ("best-fit packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: No stage but line dedup can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
