"""Line dedup: lines that stand on many sites are boilerplate and go.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation, so a
line found in a third of all rows costs one small sketch per task. Lines whose estimate is
clear of the threshold are decided by it; those within the error band, at least one site
to either side, get an exact distinct count. Lines are compared without the blanks around
them, by a 128-bit hash; blank lines are never removed.

Which lines go from a text depends on the text alone, so hits are gathered per distinct
text and joined back on its hash; a join, unlike a group, splits hot keys.

NULL sites are not counted. A NULL text stays NULL and has no lines. Repeated rows all
come back. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.session import cut_lineage

SKETCH_BITS = 12
#: Relative standard error of a sketch with 2^12 registers, and how many of them count as near.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
SIGMAS = 5


def line_hash(line: Column) -> Column:
    """Hash of a line without blanks around it; NULL for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.unhex(F.md5(bare)))


def boilerplate(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """Hashes (column line) of the lines that stand on ``min_sites`` sites or more."""
    hashes = F.array_distinct(F.transform(F.split("text", "\n"), line_hash))
    found = docs.select(F.col(site).alias("site"), F.explode(hashes).alias("line")).filter("line is not null")
    margin = max(1.0, SIGMAS * SKETCH_ERROR * min_sites)
    spread = cut_lineage(
        found.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site").cast("string"), SKETCH_BITS)).alias("sites"))
        .filter(F.col("sites") >= min_sites - margin),
        "lines-spread",
    )
    near = spread.filter(F.col("sites") <= min_sites + margin).select("line")
    exact = (
        found.join(near, "line", "left_semi")
        .distinct()
        .groupBy("line")
        .agg(F.count("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    far = spread.filter(F.col("sites") > min_sites + margin)
    return cut_lineage(far.select("line").unionByName(exact.select("line")), "lines-boilerplate")


def remove_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, text without the given lines, n_lines and n_removed of every document."""
    rows = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    hashes = F.array_distinct(F.transform(F.split("text", "\n"), line_hash))
    hits = (
        rows.select("key", F.explode(hashes).alias("line"))
        .join(lines, "line", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("line").alias("gone"))
    )
    all_lines = F.split("text", "\n")
    kept = F.when(
        F.col("gone").isNotNull(),
        F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains("gone", line_hash(x)), F.lit(False))),
    ).otherwise(all_lines)
    return (
        rows.join(hits, "key", "left")
        .select("doc_id", F.size(F.coalesce(all_lines, F.array())).cast("bigint").alias("n_lines"), kept.alias("kept"))
        .select(
            "doc_id",
            F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).alias("text"),
            "n_lines",
            (F.col("n_lines") - F.size(F.coalesce("kept", F.array()))).alias("n_removed"),
        )
    )


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 5) -> DataFrame:
    return remove_lines(docs, boilerplate(docs, site, min_sites))
