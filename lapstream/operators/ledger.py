"""Predictions, and how they are graded once the finish is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.text import compound_short, format_skill

# Look-ahead of a prediction, calibration bands, least sample.
HORIZON_LAPS = 10
BANDS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
MIN_SCORED = 10
TOP, POINTS = 3, 10

PREDICTION = (
    "session", "circuit", "lap", "total_laps", "driver", "tla", "position", "pit_lap",
    "compound", "expected_position", "margin", "decisive", "p_top3", "p_points", "p_gain",
    "n_sims", "horizon_lap", "id", "recorded_at", "note",
)


def prediction_rows(best: DataFrame, horizon: int = HORIZON_LAPS, note: str = "") -> DataFrame:
    """Log rows from best options (columns of a prediction, ``option_compound``)."""
    fresh_id = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    filled = best.withColumns(
        {
            "compound": compound_short(F.col("option_compound")),
            "horizon_lap": F.least(F.col("lap") + horizon, F.col("total_laps")),
            "id": fresh_id,
            "recorded_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
            "note": F.lit(note),
        }
    )
    return filled.select(*PREDICTION)


def finishing_positions(cars: DataFrame) -> DataFrame:
    """Final classification: cars that have a position."""
    return cars.where(F.col("position").isNotNull()).select(
        "session_id", F.col("car").alias("driver"), F.col("position").alias("actual")
    )


def with_finish(
    predictions: DataFrame, finish: DataFrame, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Predictions with ``actual``; NULL for cars without a recorded finish."""
    return predictions.join(finish.select(*keys, "driver", "actual"), [*keys, "driver"], "left")


def scored_pairs(predictions: DataFrame, finish: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """What was said and what came of it, next to "nothing changes from here".

    Every prediction stays; ``actual`` NULL marks one that is not scored.
    """
    rows = with_finish(predictions, finish, keys)
    held = F.coalesce("position", F.lit(0))
    actual = F.col("actual")

    def said(condition: Column) -> Column:
        return F.when(actual.isNotNull(), condition.cast("double"))

    expected = F.coalesce("expected_position", actual.cast("double"))
    return rows.withColumns(
        {
            "said_top3": said(F.coalesce("p_top3", F.lit(0.0))),
            "said_points": said(F.coalesce("p_points", F.lit(0.0))),
            "was_top3": said(actual <= TOP),
            "was_points": said(actual <= POINTS),
            "held_top3": said((held > 0) & (held <= TOP)),
            "held_points": said((held > 0) & (held <= POINTS)),
            "error": F.abs(expected - actual),
            "held_error": F.when(held > 0, F.abs(held - actual).cast("double")),
        }
    )


def skipped(predictions: DataFrame, finish: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Predictions for cars that have no recorded finish."""
    return predictions.join(finish.select(*keys, "driver"), [*keys, "driver"], "left_anti")


def _brier(said: str, was: str) -> Column:
    return F.coalesce(F.avg(F.pow(F.col(said) - F.col(was), F.lit(2))), F.lit(0.0))


def skill(model: Column, baseline: Column) -> Column:
    """Share of the baseline's error that is gone.

    Against a flawless baseline any error is infinitely worse.
    """
    flawless = F.when(model <= 0, 0.0).otherwise(F.lit(float("-inf")))
    return F.when(baseline <= 0, flawless).otherwise(1 - model / F.nullif(baseline, F.lit(0.0)))


def scorecard(pairs: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Brier scores, position errors, skill, caveats and verdict, one row per key."""
    zero = F.lit(0.0)
    scores = pairs.groupBy(*keys).agg(
        F.count("actual").alias("n"),
        (F.count(F.lit(1)) - F.count("actual")).alias("n_skipped"),
        _brier("said_top3", "was_top3").alias("brier_top3"),
        _brier("said_points", "was_points").alias("brier_points"),
        _brier("held_top3", "was_top3").alias("baseline_top3"),
        _brier("held_points", "was_points").alias("baseline_points"),
        F.coalesce(F.avg("error"), zero).alias("position_error"),
        F.coalesce(F.avg("held_error"), zero).alias("baseline_position_error"),
    )
    skilled = scores.withColumns(
        {
            "skill_top3": skill(F.col("brier_top3"), F.col("baseline_top3")),
            "skill_points": skill(F.col("brier_points"), F.col("baseline_points")),
        }
    )
    judged = skilled.withColumn(
        "beats_baseline",
        (F.col("skill_top3") > 0) & (F.col("position_error") < F.col("baseline_position_error")),
    )
    return judged.withColumns({"caveats": caveats(), "verdict": verdict()})


def caveats() -> Column:
    n, missed = F.col("n"), F.col("n_skipped")
    few = F.when(
        (n > 0) & (n < MIN_SCORED), F.concat(F.lit("few scored: "), n.cast("string"))
    )
    lost = F.when(missed > 0, F.concat(F.lit("skipped without a finish: "), missed.cast("string")))
    return F.array_compact(F.array(few, lost))


def verdict() -> Column:
    """nothing scored, too few, beat both, partial, or lost."""
    return (
        F.when(F.col("n") == 0, "nothing")
        .when(F.col("n") < MIN_SCORED, "too few")
        .when(F.col("beats_baseline"), "beat")
        .when(F.col("skill_top3") > 0, "partial")
        .otherwise("lost")
    )


def with_skill_text(card: DataFrame) -> DataFrame:
    return card.withColumns(
        {f"{c}_text": format_skill(F.col(c)) for c in ("skill_top3", "skill_points")}
    )


def _band(p: Column, bands: Sequence[float]) -> Column:
    """Number of the band a probability falls in; the top band includes its end."""
    found = F.when(p == bands[-1], len(bands) - 2)
    for i, (low, high) in enumerate(zip(bands, bands[1:], strict=False)):
        found = found.when((p >= low) & (p < high), i)
    return found


def calibration(
    pairs: DataFrame, keys: Sequence[str] = ("session_id",), bands: Sequence[float] = BANDS
) -> DataFrame:
    """Claimed against observed frequency per band; bands nobody claimed are left out."""
    edges = F.array(*[F.lit(float(b)) for b in bands])
    band = _band(F.col("said_top3"), bands)
    return (
        pairs.where(F.col("said_top3").isNotNull())
        .withColumn("_band", band)
        .where(F.col("_band").isNotNull())
        .groupBy(*keys, "_band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("said_top3").alias("predicted"),
            F.avg("was_top3").alias("observed"),
        )
        .select(
            *keys,
            F.element_at(edges, F.col("_band") + 1).alias("low"),
            F.element_at(edges, F.col("_band") + 2).alias("high"),
            "n",
            "predicted",
            "observed",
            (F.col("predicted") - F.col("observed")).alias("gap"),
        )
    )


def call_table(predictions: DataFrame, finish: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every call with what was expected and what happened, in lap and code order."""
    rows = with_finish(predictions, finish, keys)
    stop = F.coalesce("pit_lap", "lap")
    call = F.concat(
        F.lit("pit lap "), stop.cast("string"), F.lit(" on "), F.coalesce("compound", F.lit("?"))
    )
    result = F.when(F.col("actual").isNull(), "DNF").otherwise(
        F.concat(F.lit("P"), F.col("actual").cast("string"))
    )
    return rows.select(
        *keys,
        "lap",
        F.coalesce("tla", F.col("driver").cast("string")).alias("code"),
        call.alias("call"),
        F.coalesce("expected_position", F.lit(0.0)).alias("expected_position"),
        result.alias("result"),
        "horizon_lap",
    ).orderBy(*keys, "lap", "code")
