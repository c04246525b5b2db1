"""Chunked scans give exactly what plain windows give, also on one huge key and on NULLs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapstream.operators.scan import ranked, running, with_chunk


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = []
    for seq in range(400):
        key = "hot" if random.random() < 0.5 else random.choice(["a", "b", "c", None])
        value = None if random.random() < 0.4 else random.randint(0, 9)
        data.append((key, seq * 3, value, str(value) if value else None))
    return spark.createDataFrame(data, "key string, seq long, v long, t string").cache()


def scanned(rows, span):
    return running(
        rows,
        ["key"],
        "seq",
        number="n",
        size="size",
        sums={"total": F.col("v")},
        maxima={"top": F.col("v"), "mark": F.when(F.col("v") > 4, F.struct("v", "seq"))},
        lasts={"last_v": F.col("v"), "last_t": F.col("t")},
        lags={"before": F.col("v"), "before_seq": F.col("seq")},
        span=span,
    )


def by_seq(df):
    return {r["seq"]: r.asDict(recursive=True) for r in df.collect()}


def plain(rows):
    along = Window.partitionBy("key").orderBy("seq")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("v") > 4, F.struct("v", "seq"))
    return rows.withColumns(
        {
            "n": F.row_number().over(along),
            "size": F.count(F.lit(1)).over(Window.partitionBy("key")),
            "total": F.sum("v").over(upto),
            "top": F.max("v").over(upto),
            "mark": F.max(mark).over(upto),
            "last_v": F.last("v", ignorenulls=True).over(upto),
            "last_t": F.last("t", ignorenulls=True).over(upto),
            "before": F.lag("v").over(along),
            "before_seq": F.lag("seq").over(along),
        }
    )


@pytest.mark.parametrize("span", [1, 7, 100, 5000])
def test_chunked_equals_plain(rows, span):
    assert by_seq(scanned(rows, span)) == by_seq(plain(rows))


def test_a_row_without_order_comes_first(rows):
    early = rows.limit(1).select(
        F.lit("hot").alias("key"), F.lit(None).cast("long").alias("seq"), F.lit(77).cast("long").alias("v"), "t"
    )
    both = rows.unionByName(early)
    assert by_seq(scanned(both, 100)) == by_seq(plain(both))


def test_scan_equals_brute_force(rows):
    got = by_seq(scanned(rows, 50))
    for key in ("hot", "a", "b", "c", None):
        total, last, before, n = None, None, None, 0
        mine = sorted((r for r in rows.collect() if r["key"] == key), key=lambda r: r["seq"])
        for r in mine:
            n += 1
            if r["v"] is not None:
                total, last = (total or 0) + r["v"], r["v"]
            out = got[r["seq"]]
            assert (out["n"], out["size"]) == (n, len(mine))
            assert (out["total"], out["last_v"], out["before"]) == (total, last, before)
            before = r["v"]


@pytest.mark.parametrize("width", [1, 4, 50])
def test_ranked_in_chunks(rows, width):
    order = [F.col("v"), F.col("seq")]
    whole = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint")
    )
    chunked = ranked(rows, ["key"], order, F.floor(F.col("v") / width), "place")
    assert by_seq(chunked) == by_seq(whole)


def test_repeated_pass_keeps_chunk(rows):
    first = running(
        with_chunk(rows, "seq", 50), ["key"], "seq", number="n", span=50, chunk="chunk"
    )
    second = running(first, ["key"], "seq", maxima={"m": F.col("n")}, span=50, chunk="chunk")
    assert all(r["m"] == r["n"] for r in second.collect())
