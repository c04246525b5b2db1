import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows; shorter rows are filled up."""

    def build(rows, extra=()):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        data = [(*r, len(r[1] or ""), *["x"] * len(extra)) for r in full]
        schema = T.StructType.fromDDL(SCHEMA + "".join(f", `{c}` string" for c in extra))
        return spark.createDataFrame(data, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id to (text, lang, source)."""
    return {r.doc_id: (r.text, r.lang, r.source) for r in documents.collect()}
