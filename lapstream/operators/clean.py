"""Which laps may be used for fitting, and why the others may not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.text import compound_short, is_neutralised

# Limits of the clean-lap rules.
TRAFFIC_SECONDS = 2.0
OUTLIER_RATIO = 1.4

# The reasons a lap can be left out.
REASONS = (
    "NO_TIME",
    "FIRST_LAP",
    "IN_LAP",
    "OUT_LAP",
    "NEUTRALISED",
    "RETIRED",
    "TRAFFIC",
    "IMPLAUSIBLE",
)


def was_neutralised(statuses: str | Column = "track_statuses") -> Column:
    return F.exists(statuses, is_neutralised)


def session_best(laps: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Fastest green-flag lap without a pit visit, per session."""
    counts = ~was_neutralised() & ~F.col("entered_pit") & ~F.col("exited_pit")
    time = F.when(counts & (F.col("lap_time") > 0), F.col("lap_time"))
    return laps.groupBy(*keys).agg(F.min(time).alias("best"))


def reason_flags(
    *,
    traffic_seconds: float = TRAFFIC_SECONDS,
    outlier_ratio: float = OUTLIER_RATIO,
    exclude_first_lap: bool = True,
    exclude_traffic: bool = True,
) -> dict[str, Column]:
    """One null-safe predicate per reason, over lap columns and ``best``."""
    new_tyre = (F.col("stint") > 0) & (F.col("tyre_age") == 0)
    flags = {
        "NO_TIME": F.col("lap_time").isNull(),
        "FIRST_LAP": (F.col("lap") == 1) & F.lit(exclude_first_lap),
        "IN_LAP": F.col("entered_pit"),
        "OUT_LAP": F.col("exited_pit") | new_tyre,
        "NEUTRALISED": was_neutralised(),
        "RETIRED": F.col("retired"),
        "TRAFFIC": (F.col("interval") < traffic_seconds) & F.lit(exclude_traffic),
        "IMPLAUSIBLE": F.col("lap_time") > F.col("best") * outlier_ratio,
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def classify_laps(
    laps: DataFrame, keys: Sequence[str] = ("session_id",), best: DataFrame | None = None, **rules: float | bool
) -> DataFrame:
    """Add ``best`` and ``reasons``; an empty array marks a clean lap.

    The best table has one row per session; where ``laps`` are not all there is, it is
    given. Its join is left to Spark: broadcast
    while measured small, otherwise a sort-merge join that AQE splits on skew.
    """
    keys = list(keys)
    best = session_best(laps, keys) if best is None else best.select(*keys, "best")
    named = [F.when(flag, F.lit(name)) for name, flag in reason_flags(**rules).items()]
    return laps.join(best, keys, "left").withColumn("reasons", F.array_compact(F.array(*named)))


def clean_laps(classified: DataFrame) -> DataFrame:
    return classified.where(F.size("reasons") == 0).drop("reasons", "best")


def rejected_laps(classified: DataFrame) -> DataFrame:
    return classified.where(F.size("reasons") > 0)


def filter_totals(classified: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    clean = F.sum(F.when(F.size("reasons") == 0, 1).otherwise(0))
    totals = classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), clean.alias("clean")
    )
    return totals.withColumns(
        {
            "excluded": F.col("total") - F.col("clean"),
            "clean_fraction": F.col("clean") / F.nullif(F.col("total"), F.lit(0)),
        }
    )


def reason_counts(classified: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Laps per reason; a lap with two reasons counts under both."""
    return (
        classified.select(*keys, F.explode("reasons").alias("reason"))
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("laps"))
        .orderBy(F.desc("laps"), "reason")
    )


def by_compound(clean: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Sample size, age range and fastest lap per compound, biggest sample first."""
    return (
        clean.where(F.col("lap_time").isNotNull())
        .groupBy(*keys, compound_short(F.col("compound")).alias("code"))
        .agg(
            F.count(F.lit(1)).alias("laps"),
            F.min("tyre_age").alias("min_age"),
            F.max("tyre_age").alias("max_age"),
            F.min("lap_time").alias("fastest"),
        )
        .orderBy(F.desc("laps"), "code")
    )
