import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd(df):
    """Extra columns with names that operators use themselves."""
    names = ("block", "shard", "data", "keep_0", "n_words", "n_lines", "score", "predicted", "name", "rep", "root", "part", "items", "gram", "spans", "h", "payload", "local", "_row", "_ws", "_id", "class_id", "contaminated")
    return df.withColumns({n: F.lit(7) for n in names})
