import pytest
from llm_helpers import SCHEMA, prose, table

@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, copies, repeated rows, long and foreign texts."""
    base = prose(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "two words"),
        (9, prose(2, 30_000)), (10, "é日本語 \U0001f600 naïve ​ x"), (None, base), (None, None), (11, "a\n\n" + prose(3, 60) + "\n" + prose(1, 120)),
        (12, "=" * 5000), (13, "<|endoftext|> don't 'S  \n\n x<|endoftext|>"), (14, "na na na na na na na na na na na na"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 15)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
