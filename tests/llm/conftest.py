import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None) -> DataFrame:
    """A documents table with a column whose name clashes with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources or ["a"] * len(texts))]
    clash = ("row", "n", "k1", "label", "at", "sig", "size", "key", "range", "best", "run")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def docs(spark):
    return lambda *a, **k: documents(spark, *a, **k)
