"""Race history from lap tables: neutralised laps, starts of periods, retirements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.text import RED_FLAG, SAFETY_CAR, VIRTUAL_SAFETY_CAR
from lapstream.session import cut_lineage

# Flag columns and the status code behind each.
FLAGS = {"sc": SAFETY_CAR, "vsc": VIRTUAL_SAFETY_CAR, "red": RED_FLAG}


def lap_statuses(observed: DataFrame, race: str = "session_id") -> DataFrame:
    """One row per (race, lap): a status counts if any car saw it.

    ``status`` is the text of all codes a car met on the lap, such as ``124``.
    """
    return (
        observed.where(F.col("lap").isNotNull())
        .groupBy(race, "lap")
        .agg(*[F.bool_or(F.col("status").contains(c)).alias(n) for n, c in FLAGS.items()])
    )


def laps_with(statuses: DataFrame, flag: str, race: str = "session_id") -> DataFrame:
    return statuses.where(flag).select(race, "lap")


def period_starts(active: DataFrame, race: str = "session_id") -> DataFrame:
    """First lap of every unbroken run: laps whose previous lap is not active.

    An anti join on (race, lap - 1), so runs need no ordered pass over the race.
    """
    followed = active.select(race, (F.col("lap") + 1).alias("lap"))
    return active.join(followed, [race, "lap"], "left_anti")


def race_totals(observed: DataFrame, race: str = "session_id") -> DataFrame:
    return observed.groupBy(race).agg(F.max("lap").alias("total_laps"))


def retirements(results: DataFrame, observed: DataFrame, race: str = "session_id") -> DataFrame:
    """Lap each car classified ``R`` stopped on: its last lap, lap 1 if it ran none."""
    out = results.where(F.upper(F.trim("classified")) == "R").select(race, "driver")
    last = observed.groupBy(race, "driver").agg(F.max("lap").alias("last_lap"))
    stopped = F.greatest(F.lit(1), F.coalesce(F.col("last_lap"), F.lit(0)))
    return out.join(last, [race, "driver"], "left").select(
        race, "driver", stopped.cast("bigint").alias("lap")
    )


def starters(results: DataFrame, race: str = "session_id") -> DataFrame:
    return results.groupBy(race).agg(F.count(F.lit(1)).alias("starters"))


def race_history(
    observed: DataFrame, results: DataFrame, dimension: DataFrame, race: str = "session_id"
) -> DataFrame:
    """One record per race in the shape of the history file.

    All laps a record lists are stacked first and gathered in one aggregate. The
    arrays hold lap numbers of one race, no more than the race is long; the models
    read the long tables and never need them.
    """
    statuses = cut_lineage(lap_statuses(observed, race), "statuses")
    listed = [retirements(results, observed, race).select(race, "lap", F.lit("retirements").alias("tag"))]
    for flag in FLAGS:
        active = laps_with(statuses, flag, race)
        listed.append(active.withColumn("tag", F.lit(f"{flag}_laps")))
        listed.append(period_starts(active, race).withColumn("tag", F.lit(f"{flag}_starts")))
    tags = ["retirements", *[f"{f}_{part}" for f in FLAGS for part in ("laps", "starts")]]
    stacked = reduce(DataFrame.unionByName, listed)
    arrays = stacked.groupBy(race).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.col("lap")))).alias(t) for t in tags]
    )
    record = (
        dimension.join(race_totals(observed, race), race)
        .join(starters(results, race), race, "left")
        .join(arrays, race, "left")
    )
    empty = F.array().cast("array<bigint>")
    return record.withColumns(
        {
            **{t: F.coalesce(t, empty) for t in tags},
            "starters": F.coalesce("starters", F.lit(0).cast("bigint")),
        }
    )


def complete(history: DataFrame) -> DataFrame:
    """Records that carry every field; older ones are collected again."""
    has: Column = F.lit(True)
    for name in ("retirements", "starters"):
        has = has & F.col(name).isNotNull() if name in history.columns else F.lit(False)
    return history.where(has)


def upsert_history(
    held: DataFrame, collected: DataFrame, keys: tuple[str, ...] = ("season", "round")
) -> DataFrame:
    """Keep complete held records, add collected races not held yet, sort by key."""
    kept = complete(held)
    fresh = collected.join(kept.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).orderBy(*keys)
