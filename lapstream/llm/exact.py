"""Exact dedup: a 128-bit content hash groups documents, bytes confirm the groups.

Texts are compared after lower-casing A-Z. Only hashes, ids and digests of all rows are
shuffled. Whole texts are aggregated only within groups of two or more, as the least and
the greatest text of a group: both are combined before the shuffle, so a group holding a
third of the corpus sends one pair per task. Where the two differ the hash has collided,
and the group is split by the SHA-256 of its texts.

NULL texts count as empty. Of rows with the same text and id one stays. A NULL id loses
to any other. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.llm.common import ascii_lower, content_key
from lapstream.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def find_copies(
    docs: DataFrame, keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, content.

    ``keep`` says which id of a group stays, ``smallest`` or ``largest``. ``content`` is
    the key of the raw text used by :func:`drop_copies`.
    """
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("t"), F.col("text").alias("raw"))
    texts = texts.select("*", hash_of(F.col("t")).alias("h"))
    rows = cut_lineage(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "h",
            F.sha2(F.col("t"), 256).alias("text_sha256"),
            content_key(F.col("raw")).alias("content"),
        ),
        "copies-rows",
    )
    repeated = cut_lineage(
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"),
        "copies-repeated",
    )
    collided = cut_lineage(
        texts.select("h", "t")
        .join(repeated, "h", "left_semi")
        .groupBy("h")
        .agg(F.min("t").alias("least"), F.max("t").alias("greatest"))
        .filter("least <> greatest")
        .select("h", F.lit(True).alias("split")),
        "copies-collided",
    )
    told = rows.join(collided, "h", "left").withColumn("variant", F.expr("if(split, text_sha256, '')"))
    if keep == "largest":
        order = F.coalesce("doc_id", F.lit(-(1 << 63)))
        best = [F.max("doc_id").alias("keep_id"), F.max_by("row", order).alias("best")]
    else:
        order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        best = [F.min("doc_id").alias("keep_id"), F.min_by("row", order).alias("best")]
    groups = told.groupBy("h", "variant").agg(*best, F.count(F.lit(1)).alias("group_size"))
    return told.join(groups, ["h", "variant"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("best")).alias("kept"),
        "text_sha256",
        "content",
    )


def verdict_of(copies: DataFrame) -> DataFrame:
    """What :func:`~lapstream.llm.common.apply_verdict` needs: keys that lose rows."""
    return (
        copies.filter("group_size > 1")
        .groupBy("doc_id", "content")
        .agg(F.max("kept").alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("not keep or n > 1")
        .select("doc_id", "content", "keep")
    )
