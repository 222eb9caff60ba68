"""Queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import splitting
from corpusloom.operators.serving import DIMENSIONS
from corpusloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where there is some."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WS = r"[ \t\n\r\f\x0B]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return rf"regexp_replace({strip_sql(x)}, '{_WS}+', ' ', 'g')"


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def sentences_sql(rows: str) -> str:
    """Common tables up to se (doc_id, s): the sentences of ``rows``, a SELECT of doc_id and text."""
    blank, unended = f"[{splitting.SPACE}]", splitting.UNENDED.replace(r"\z", "").replace("'", "''")
    strip = lambda x: f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"
    return rf"""
sp AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g') AS t FROM ({rows})),
sq AS (SELECT *, string_split(regexp_replace(t, '([.!?]{blank}+)({splitting.CAPITAL.replace("'", "''")})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM sp),
sr AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: i = len(p) OR NOT regexp_matches(p[i], '(?:{unended})\.*\n?[.!?]{blank}+\z')) AS e FROM sq),
ss AS (SELECT *, list_filter(list_transform(e, lambda x, i: {strip("array_to_string(p[(CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) + 1:x], '')")}), lambda x: x <> '') AS f, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS r FROM sr),
se AS (SELECT doc_id, CASE WHEN len(f) <= 1 AND length(t) > {splitting.LONG_LINE} AND len(r) > 1 THEN r ELSE f END AS s FROM ss)"""


def bag_sql(x: str) -> str:
    """The hashed bag of a text before it is scaled: numbers of words by bucket, those counting as -1 taken off."""
    hashes = f"list_transform({tokens_sql(f'coalesce({x}, {chr(39) * 2})')}, lambda w: CAST(concat('0x', left(md5(w), 8)) AS BIGINT))"
    return f"list_transform(range({DIMENSIONS}), lambda b: CAST(coalesce(list_sum(list_transform(list_filter({hashes}, lambda h: h % {DIMENSIONS} = b), lambda h: CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)), 0) AS DOUBLE))"
