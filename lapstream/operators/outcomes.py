"""Aggregates over outcome draws: how an option or a car is expected to finish.

A draw row is ``session_id, option_id, draw, driver, elapsed, retired, retired_on,
position``. Draws come from outside; nothing here makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.operators.scan import ranked

# Options closer than this in expected position are no clear call.
DECISIVE_MARGIN = 0.15
TOP, POINTS = 3, 10
CORE_MASS = 0.95

DRAW = ("session_id", "option_id", "draw")
OPTION = ("session_id", "option_id")
CAR = (*OPTION, "driver")


def classify_draws(draws: DataFrame) -> DataFrame:
    """Finishing position per draw: finishers by time, then retirements, latest first.

    ``total_laps`` must be on the rows. Cars are ranked in time bands.
    """
    key = F.when(F.col("retired"), F.col("total_laps") - F.col("retired_on")).otherwise(
        F.col("elapsed")
    )
    keyed = draws.withColumn("_key", key.cast("double"))
    band = F.struct(F.col("retired").alias("r"), F.floor(F.col("_key") / 60).alias("b"))
    order = [F.col("retired"), F.col("_key"), F.col("driver")]
    placed = ranked(keyed, list(DRAW), order, band, "classified")
    return placed.drop("_key")


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def car_outcomes(draws: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Mean position and chances per car, in one combined aggregate."""
    position = F.col("position")
    return draws.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg(position.cast("double")).alias("mean_position"),
        _share(position <= TOP).alias("p_top3"),
        _share(position <= POINTS).alias("p_points"),
        _share(F.col("retired")).alias("p_retired"),
        (1 - _share(F.col("retired"))).alias("p_finished"),
    )


def probability_top(draws: DataFrame, n: int, keys: Sequence[str] = CAR) -> DataFrame:
    return draws.groupBy(*keys).agg(_share(F.col("position") <= n).alias("probability"))


def position_probabilities(draws: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """One row per car and position reached. The total comes from the same counts."""
    counts = draws.groupBy(*keys, "position").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys, "position", (F.col("n") / F.sum("n").over(whole)).alias("probability")
    )


def distribution(draws: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """The same as ``MAP<position, probability>``: no more entries than places in the field."""
    return position_probabilities(draws, keys).groupBy(*keys).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("position", "probability")))
        ).alias("distribution")
    )


def ahead_of(draws: DataFrame, subjects: DataFrame) -> DataFrame:
    """Chance that each other car finishes ahead of the subject, paired by draw.

    ``subjects`` has one car per session, so each draw row meets one row.
    """
    ours = draws.join(subjects.select("session_id", "driver"), ["session_id", "driver"]).select(
        *DRAW, F.col("driver").alias("subject"), F.col("position").alias("_ours")
    )
    paired = draws.join(ours, list(DRAW)).where(F.col("driver") != F.col("subject"))
    return paired.groupBy("session_id", "option_id", "subject", "driver").agg(
        _share(F.col("position") < F.col("_ours")).alias("probability")
    )


def option_scoreboard(draws: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per option of the subject car: expected finish, chances, and the spread.

    ``subjects``: ``session_id, driver, start_position``.
    """
    mine = draws.join(subjects, ["session_id", "driver"])
    position = F.col("position")
    board = mine.groupBy(*OPTION, "driver", "start_position").agg(
        F.avg(position.cast("double")).alias("mean_position"),
        _share(position <= TOP).alias("p_top3"),
        _share(position <= POINTS).alias("p_points"),
        _share(position < F.col("start_position")).alias("p_gain"),
        _share(F.col("retired")).alias("p_retire"),
        F.count(F.lit(1)).alias("n_sims"),
    )
    return board.join(distribution(mine, OPTION), list(OPTION))


def rank_options(board: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Options by expected finish, ties in option order, with the margin to the next.

    A decision has a dozen options, so the window holds a handful of rows.
    """
    best = Window.partitionBy(*keys).orderBy("mean_position", "option_id")
    margin = F.coalesce(F.lead("mean_position").over(best) - F.col("mean_position"), F.lit(0.0))
    return board.withColumns({"rank": F.row_number().over(best), "margin": margin}).withColumn(
        "decisive", F.col("margin") >= DECISIVE_MARGIN
    )


def recommendation(board: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return rank_options(board, keys).where("rank = 1").drop("rank")


def threat_ranking(draws: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chance that each threatening car comes out ahead, worst threat first.

    ``candidates``: ``session_id, subject, driver`` and the gap.
    """
    subjects = candidates.select("session_id", F.col("subject").alias("driver")).distinct()
    return (
        ahead_of(draws, subjects)
        .join(candidates, ["session_id", "subject", "driver"])
        .orderBy("session_id", "option_id", F.desc("probability"), "driver")
    )


def likely_core(probabilities: DataFrame, keys: Sequence[str] = CAR, mass: float = CORE_MASS) -> DataFrame:
    """Span and mode of the fewest positions that hold 95 % of the chance.

    The window holds one row per position of the field.
    """
    ordered = Window.partitionBy(*keys).orderBy(F.desc("probability"), "position")
    before = F.sum("probability").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    core = probabilities.withColumn("_before", F.coalesce(before, F.lit(0.0)))
    # A hair of slack, so that rounding of a sum that reaches the mass adds no place.
    kept = core.where(F.col("_before") < mass - 1e-9)
    return kept.groupBy(*keys).agg(
        F.min("position").alias("low"),
        F.max("position").alias("high"),
        F.max_by("position", F.struct("probability", -F.col("position"))).alias("mode"),
        F.sum("probability").alias("mass"),
    )
