"""A corpus from raw documents to tokens: language ID, exact dedup, near dedup, mix, BPE.

Every stage takes the documents that the stage before kept, reads them whole, and gives
documents back; the last gives a row per document taken, with digests of its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapstream.llm import bpe, exact, langid, mixing, near, simhash
from lapstream.llm.common import apply_verdict
from lapstream.llm.queries import TOKENIZER, digests
from lapstream.session import cut_lineage, scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; texts without a letter go."""
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    verdict = cut_lineage(exact.verdict_of(exact.find_copies(docs)), "pipeline-exact")
    return apply_verdict(docs, verdict)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word likeness of 0.8 or more."""
    verdict = cut_lineage(simhash.verdict_of(near.near_copies(docs)), "pipeline-near")
    return apply_verdict(docs, verdict)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs, cut_lineage(mixing.mix(docs), "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document taken, as digests."""
    return digests(bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The vector profiles of the first stage and the hash index of the third have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
