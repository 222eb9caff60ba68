"""Findings of the fourth round."""

import math

import duckdb

from corpusloom import plans


def test_nonascii_filter_takes_empty_texts(spark, tmp_path):
    texts = ["", None, "", "abc", "é", "\0é", " " * 60, "é" * 50, "é" * 51, "é" * 60, "😀" * 9 + "a" * 51, "😀" * 10 + "a" * 50, "é" + "a" * 127]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    said = sorted(duck.execute(plans.ORACLE_SQL["nonascii_filter"]).fetchall())
    got = sorted(map(tuple, plans.QUERIES["nonascii_filter"](spark, str(tmp_path)).collect()))
    assert list(map(repr, got)) == list(map(repr, said))
    assert [i for i, share in got if math.isnan(share)] == [0, 2] and 1 not in dict(got)


def test_nonascii_filter_rounds_as_its_sql(spark, tmp_path):
    texts = ["é" * (length * n // 10000) + "a" * (length - length * n // 10000) for length in (128, 640, 1280, 3200) for n in range(0, 1500, 7)] + ["é" * 41 + "a" * 599]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    said = sorted(duck.execute(plans.ORACLE_SQL["nonascii_filter"]).fetchall())
    got = sorted(map(tuple, plans.QUERIES["nonascii_filter"](spark, str(tmp_path)).collect()))
    assert got == said and got[-1][1] == 0.064062
