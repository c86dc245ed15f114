import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


LONG = "word " * 30_000 + "end"


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names are ours."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta\nsecond line", "en", "s1", 10, "x"),
        (1, "Alpha beta gamma delta epsilon zeta\nsecond line", "en", "s1", 10, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "s2", 0, "y"),
        (4, LONG, "en", "s1", len(LONG), "z"),
        (5, " \t\r\n \n", "de", None, 5, None),
        (None, "no id at all here today", "en", "s3", 20, "w"),
        (6, "Alpha beta gamma delta epsilon zeta\nsecond line", None, "s3", 10, "x"),
        (7, "naïve café ▁ ▁ \x00 😀 mail me at a.b@c.de or +49 (30) 1234-5678", "fr", "s4", 10, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string")


@pytest.fixture
def empty(odd):
    return odd.where(F.lit(False))
