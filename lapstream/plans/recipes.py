"""Whole questions over files: what one asks of a recording, a history or a log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapstream.functions import race
from lapstream.functions.text import normalise_circuit
from lapstream.operators import clean, fold, grid, hazard, laps, ledger, pace
from lapstream.session import cut_lineage
from lapstream.sources import history, predictions, recordings


class Feed(NamedTuple):
    """Opened feed rows."""

    timing: DataFrame
    stints: DataFrame
    drivers: DataFrame
    session: DataFrame


def open_feed(events: DataFrame) -> Feed:
    """Open payloads once into typed tables that everything else reads."""
    return Feed(
        cut_lineage(fold.timing_deltas(events), "timing"),
        cut_lineage(fold.stint_deltas(events), "stints"),
        cut_lineage(fold.driver_deltas(events), "drivers"),
        cut_lineage(fold.session_deltas(events), "session"),
    )


def cars(feed: Feed) -> DataFrame:
    return fold.car_state(
        fold.timing_state(feed.timing),
        fold.stint_state(feed.stints),
        fold.driver_state(feed.drivers),
    )


def lap_records(feed: Feed) -> DataFrame:
    return laps.extract_laps(feed.timing, feed.stints, feed.drivers, feed.session)


def topics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events per topic, and the totals."""
    events = recordings.to_events(recordings.decode_lines(recordings.scan_recording(spark, path)))
    return fold.topic_census(events), fold.census_total(events)


def board(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The timing board at the end of each recording."""
    return fold.timing_board(cars(open_feed(recordings.read_recording(spark, path))), limit)


def lap_report(spark: SparkSession, path: str, **rules: float | bool) -> dict[str, DataFrame]:
    """Recording to clean-lap report, pace fit and fuel cross-check."""
    feed = open_feed(recordings.read_recording(spark, path))
    classified = cut_lineage(clean.classify_laps(lap_records(feed), **rules), "classified")
    usable = clean.clean_laps(classified)
    fits = cut_lineage(pace.fit_pace(usable), "fits")
    length = fold.session_state(feed.session).select("session_id", "total_laps")
    burn = race.burn_per_lap(F.col("total_laps"))
    fuel = fits.join(length.where("total_laps > 0"), "session_id").select(
        "session_id",
        race.seconds_per_lap(F.col("total_laps")).alias("prior_sec_per_lap"),
        race.implied_seconds_per_kg(F.col("trend"), burn).alias("implied_sec_per_kg"),
    )
    return {
        "totals": clean.filter_totals(classified),
        "reasons": clean.reason_counts(classified),
        "by_compound": clean.by_compound(usable),
        "fits": fits,
        "coefficients": pace.coefficient_rows(fits),
        "fuel": fuel,
    }


def hazard_report(
    spark: SparkSession,
    path: str,
    kind: str = "sc",
    shrinkage: float = hazard.SAFETY_CAR_SHRINKAGE,
    circuit: str | None = None,
    total_laps: int = 70,
    field: int = 22,
) -> dict[str, DataFrame]:
    """Both hazard fits of a history, and the risk at one circuit if named."""
    held = history.load_history(spark, path).withColumn(
        "race_id", F.concat_ws("-", "season", "round")
    )
    tables = hazard.from_history(held)
    races, gone = tables["races"], tables["retirements"]
    counts = cut_lineage(
        hazard.neutralisation_counts(races, tables["starts"], tables["active"], kind, "race_id"),
        "counts",
    )
    cars_at_risk = cut_lineage(hazard.attrition_counts(races, gone, "race_id"), "counts")
    out = {
        "summary": hazard.hazard_summary(races, counts),
        "baseline": hazard.baseline(counts),
        "factors": hazard.circuit_factors(counts, shrinkage),
        "races": hazard.circuit_races(races),
        "attrition": hazard.attrition_summary(races, gone, "race_id"),
        "attrition_baseline": hazard.baseline(cars_at_risk),
        "attrition_factors": hazard.circuit_factors(cars_at_risk, hazard.ATTRITION_SHRINKAGE),
    }
    if circuit is not None:
        asked = spark.range(1).select(
            F.lit(circuit).alias("circuit"), F.lit(total_laps).cast("bigint").alias("total_laps")
        )
        out["risk"] = hazard.mid_race_risk(asked, hazard.hazard_curves(counts, shrinkage)).drop("curve")
        curves = hazard.hazard_curves(cars_at_risk, hazard.ATTRITION_SHRINKAGE)
        total = F.col("total_laps")
        retires = hazard.probability_within(F.lit(1), total, total)
        out["retirements"] = hazard.with_curve(asked, curves).select(
            normalise_circuit(F.col("circuit")).alias("circuit"),
            retires.alias("per_car"),
            (retires * field).alias("expected"),
        )
    return out


def grid_at(spark: SparkSession, path: str, lap: int) -> dict[str, DataFrame]:
    """What was known at a lap: the fit or its refusal, grid and candidate stops.

    Grid and options only come for sessions whose fit is usable. The draws that
    rank the options come from outside.
    """
    events = recordings.read_recording(spark, path)
    cutoffs = laps.lap_cutoffs(fold.session_deltas(events), [lap])
    feed = open_feed(laps.as_of_lap(events, cutoffs).drop("as_of_lap"))
    usable = cut_lineage(clean.clean_laps(clean.classify_laps(lap_records(feed))), "clean")
    fits = cut_lineage(pace.fit_pace(usable), "fits")
    good = pace.usable_fits(fits)
    placed = grid.with_place(cars(feed).join(good.select("session_id"), "session_id", "left_semi"))
    entries = grid.grid_entries(cut_lineage(placed, "placed"), pace.pace_table(usable, good))
    length = F.coalesce(F.nullif("total_laps", F.lit(0)), F.lit(lap + 20))
    state = fold.session_state(feed.session).select(
        "session_id", F.lit(lap).cast("bigint").alias("lap"), length.alias("total_laps")
    )
    return {
        "fits": fits,
        "refused": pace.refused_fits(fits).select("session_id", "refusals"),
        "grid": entries,
        "options": grid.candidate_options(state.join(good.select("session_id"), "session_id")),
    }


def score_log(
    spark: SparkSession, log: str, recording: str, sessions: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Grade a prediction log against the finish of a recording.

    ``sessions`` says which recorded session each session of the log is. Without it the
    recording must be of one session, which is taken for all of the log.
    """
    said = predictions.read_predictions(spark, log)
    feed = open_feed(recordings.read_recording(spark, recording))
    finish = cut_lineage(ledger.finishing_positions(cars(feed)), "finish")
    keys: tuple[str, ...] = ()
    if sessions is None:
        if len(finish.select("session_id").distinct().limit(2).collect()) > 1:
            raise ValueError("the recording holds several sessions; say which is which")
        finish = finish.drop("session_id")
    else:
        named = spark.createDataFrame(list(sessions.items()), "session string, session_id string")
        said, keys = said.join(named, "session", "left"), ("session_id",)
    pairs = cut_lineage(ledger.scored_pairs(said, finish, keys), "pairs")
    return {
        "card": ledger.scorecard(pairs, ("session",)),
        "calibration": ledger.calibration(pairs, ("session",)),
        "calls": ledger.call_table(said, finish, keys),
    }
