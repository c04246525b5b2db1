"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``. A NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def content_key(text: Column) -> Column:
    """64 bits of a text, to tell rows of one id apart. NULL differs from empty."""
    return F.xxhash64(text, text.isNull())


def apply_verdict(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Filter whole rows of ``docs`` by a verdict on (doc_id, content key).

    ``verdict`` holds doc_id, content, keep and needs a row only for keys whose rows go,
    or of which one row of several equal ones is to stay. Keys it lacks stay as they are.
    """
    key = verdict.select(
        F.col("doc_id").alias("_v_id"), F.col("content").alias("_v_content"), F.col("keep").alias("_v_keep")
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        content_key(F.col("text")).alias("_content"),
    )
    judged = packed.join(
        key,
        F.col("_id").eqNullSafe(F.col("_v_id")) & (F.col("_content") == F.col("_v_content")),
        "left",
    )
    plain = judged.filter(F.col("_v_keep").isNull()).select("_doc.*")
    once = judged.filter("_v_keep").dropDuplicates(["_id", "_content"]).select("_doc.*")
    return plain.unionByName(once)
