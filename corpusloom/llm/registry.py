"""The queries of this package, and their SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.alignment import op13_token_alignment
from corpusloom.llm.bpe import op4_bpe_roundtrip
from corpusloom.llm.collocations import OP11_SQL, op11_collocations
from corpusloom.llm.common import table
from corpusloom.llm.embeddings import op10_embedding_dedup
from corpusloom.llm.importance import op9_quality_classifier
from corpusloom.llm.linededup import OP8_SQL, op8_line_dedup
from corpusloom.llm.nearest import OP12_SQL, op12_nearest_neighbours
from corpusloom.llm.packing import op5_bestfit_packing
from corpusloom.llm.quality import op1_quality_rules
from corpusloom.llm.simhash import op2_simhash_dedup
from corpusloom.llm.suffixes import op3_suffix_array_dedup
from corpusloom.llm.tokencounts import op7_token_counts
from corpusloom.llm.toxicity import op6_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def over_documents(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


def over_documents_and_labels(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": over_documents_and_labels(op1_quality_rules),
    "op2_simhash_dedup": over_documents(op2_simhash_dedup),
    "op3_suffix_array_dedup": over_documents(op3_suffix_array_dedup),
    "op4_bpe_roundtrip": over_documents(op4_bpe_roundtrip),
    "op5_bestfit_packing": over_documents(op5_bestfit_packing),
    "op6_toxicity": over_documents_and_labels(op6_toxicity),
    "op7_token_counts": over_documents(op7_token_counts),
    "op8_line_dedup": over_documents(op8_line_dedup),
    "op9_quality_classifier": over_documents_and_labels(op9_quality_classifier),
    "op10_embedding_dedup": lambda spark, sf_dir: op10_embedding_dedup(table(spark, sf_dir, "embeddings")),
    "op11_collocations": over_documents(op11_collocations),
    "op12_nearest_neighbours": lambda spark, sf_dir: op12_nearest_neighbours(table(spark, sf_dir, "embeddings")),
    "op13_token_alignment": over_documents(op13_token_alignment),
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_nearest_neighbours": OP12_SQL,
}
