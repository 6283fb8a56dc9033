import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column whose name clashes with results."""
    long_ = "word " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "same text here for you", "en", None, 5), (5, "same text here for you", None, "b", 5), (5, "same text here for you", None, "b", 5), (None, "no id at all", "fr", "b", 1), (6, long_, "en", "a", 9), (7, "été à la plage \U0001f642", "fr", "b", 2)]
    df = spark.createDataFrame(rows, DDL)
    return df.selectExpr("*", "'x' AS kept", "1 AS h", "2 AS fp", "3 AS score", "4 AS size", "5 AS row", "6 AS component")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
