"""Mixing sources to target weights by the cube method.

Targets: sources, ordered by code point with NULL last, take the weights in turn and share
``share`` times all words; a source is held at ``cap`` times its own words and its excess
goes to the others by weight, again and again until none is above.

A source with rate target / words takes every document floor(rate) times; the rest of the
rate is each document's chance of one copy more. The cube method settles these chances so
that both the words and the documents of a source come out at their expected numbers:
chances move along the null space of the two constraints until one of them is 0 or 1.
This runs in blocks of about ``BLOCK`` documents, chosen by hash, so a source of any size
is spread over many tasks. What a block cannot settle, two documents at most, is settled in
further rounds over ever fewer blocks. The last block of a source ends with a landing of a
few dozen documents, which are rounded so that the words come out near the target.

All draws follow from ids and contents, so runs over the same rows agree. Documents
without words take no part and are taken floor(rate) times with no words. Rows equal in
all columns used are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapstream.llm.common import content_key, word_count
from lapstream.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK = 4096
LANDING = 64
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, docs and target, from rows of source and size."""
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.expr("if(size > 0, 1, 0)")).alias("docs")
    )
    # Rank of a source: its place in its range of sources and the sources in ranges before.
    ranged = cut_lineage(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("place", F.monotonically_increasing_id()),
        "mix-sources",
    ).withColumn("part", F.shiftright("place", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    rank = F.col("start") + F.col("place") - F.shiftleft("part", 33)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighted = cut_lineage(
        ranged.join(starts, "part").select("source", "source_size", "docs", weight.alias("weight")), "mix-weights"
    )
    most = F.col("source_size") * cap
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    scale, held = 0.0, -1
    while True:
        above = F.col("weight") * scale > most
        n, fixed, free = weighted.agg(
            F.sum(above.cast("int")), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not free or n == held:
            break
        held, scale = n, (share * words - (fixed or 0.0)) / free
    return weighted.select("source", "source_size", "docs", F.least(F.col("weight") * scale, most).alias("target"))


def settle_block(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Flight: move chances until at most two are neither 0 nor 1."""
    x = list(chances)
    active: list[int] = []
    for i in range(len(x)):
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (float(sizes[c] - sizes[b]), float(sizes[a] - sizes[c]), float(sizes[b] - sizes[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        active = move(x, active, u, draw)
    return x


def move(x: list[float], at: list[int], u: Sequence[float], draw: random.Random) -> list[int]:
    """One step along ``u`` or against it, to the nearest wall; the open ones remain."""
    ahead = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(at, u, strict=True) if v)
    back = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(at, u, strict=True) if v)
    step = ahead if draw.random() * (ahead + back) < back else -back
    for i, v in zip(at, u, strict=True):
        x[i] += step * v
        if x[i] < TINY:
            x[i] = 0.0
        elif x[i] > 1 - TINY:
            x[i] = 1.0
    return [i for i in at if 0.0 < x[i] < 1.0]


def settle_all(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Flight and landing of the last block of a source; sizes fall.

    Up to ``LANDING`` documents of all sizes are held back from the flight. They and what
    the flight leaves open are then rounded from large to small, each to the side that
    brings the words nearer to their expected number.
    """
    held = min(LANDING, len(sizes) // 4)
    back = {len(sizes) - 1 - i * len(sizes) // held for i in range(held)} if held else set()
    fly = [i for i in range(len(sizes)) if i not in back]
    x = list(chances)
    for i, v in zip(fly, settle_block([sizes[i] for i in fly], [x[i] for i in fly], draw), strict=True):
        x[i] = v
    owed = 0.0
    for i, v in enumerate(x):
        if 0.0 < v < 1.0:
            x[i] = 1.0 if abs(owed + sizes[i] * (v - 1)) <= abs(owed + sizes[i] * v) else 0.0
            owed += sizes[i] * (v - x[i])
    return x


def flight(rows: DataFrame, seed: int, final: bool) -> DataFrame:
    """One round over (source, block)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "content"], ascending=[False, True, True], kind="stable")
        head = frame.iloc[0]
        draw = random.Random(f"{seed} {head['source']!r} {head['block']} {len(frame)}")
        sizes = frame["size"].tolist()
        settle = settle_all if final else settle_block
        return frame.assign(x=settle(sizes, frame["x"].tolist(), draw))

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and content of every document."""
    sized = cut_lineage(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), content_key(F.col("text")).alias("content")
        ),
        "mix-sizes",
    )
    targets = cut_lineage(source_targets(sized, weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(
            targets.select(F.col("source").alias("s"), "source_size", "docs", "target"),
            F.col("source").eqNullSafe(F.col("s")),
        )
        .drop("s")
        .withColumn("whole", F.floor(rate + TINY))
        .withColumn("x", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        .withColumn("x", F.expr(f"if(size = 0 or x < {TINY}, 0D, x)"))
    )
    still = rows.filter("x = 0")
    open_ = rows.filter("x > 0").withColumn("left", F.col("docs"))
    parts = []
    most = targets.agg(F.max("docs")).first()[0] or 0
    turn = 0
    while True:
        blocks = F.ceil(F.col("left") / block)
        spread = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", "content", F.lit(turn)), blocks))
        single = flight(spread.filter(blocks <= 1), seed + turn, True)
        parts.append(single)
        if most <= block:
            break
        several = cut_lineage(flight(spread.filter(blocks > 1), seed + turn, False), "mix-round")
        parts.append(several.filter("x = 0 or x = 1"))
        open_ = several.filter("x > 0 and x < 1").withColumn("left", 2 * F.ceil(F.col("left") / block))
        most = 2 * -(-most // block)
        turn += 1
    columns = ["doc_id", "size", "source_size", "target", "whole", "x", "content"]
    done = still.select(columns)
    for part in parts:
        done = done.unionByName(part.select(columns))
    copies = (F.col("whole") + F.col("x")).cast("bigint")
    return done.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
        "content",
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them."""
    key = mixed.groupBy(F.col("doc_id").alias("_m_id"), F.col("content").alias("_m_content")).agg(
        F.sum("copies").alias("_m_copies"), F.count(F.lit(1)).alias("_m_rows")
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        content_key(F.col("text")).alias("_content"),
    )
    told = packed.join(
        key, F.col("_id").eqNullSafe(F.col("_m_id")) & (F.col("_content") == F.col("_m_content"))
    ).filter("_m_copies > 0")
    single = told.filter("_m_rows = 1")
    several = told.filter("_m_rows > 1").dropDuplicates(["_id", "_content"])
    return (
        single.unionByName(several)
        .select("_doc", F.explode(F.sequence(F.lit(1), F.col("_m_copies").cast("int"))))
        .select("_doc.*")
    )
