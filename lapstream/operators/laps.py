"""Completed laps, each with the state of its car and track when it was completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.text import (
    NEUTRALISED,
    TRACK_STATUS_NAMES,
    interval_seconds,
)
from lapstream.operators.fold import CAR, SESSION
from lapstream.operators.scan import CHUNK_SPAN, running
from lapstream.session import cut_lineage

CONTEXT = (
    "laps_completed", "position", "gap_to_leader", "interval_text", "in_pit", "pit_out",
    "retired", "stopped",
)
CODES = tuple(TRACK_STATUS_NAMES)


def car_timeline(timing: DataFrame, stints: DataFrame, drivers: DataFrame) -> DataFrame:
    """All rows that touch a car, one per (car, event), ready for one running scan.

    Stint rows of one event are reduced to the highest stint they name and the
    latest known compound and age, which is all a lap needs to know of them.
    """
    timed = timing.select(
        *CAR, "seq", "session_time", "completes_lap", "lap_time", *CONTEXT
    ).withColumn(
        "lap_sent", F.col("laps_completed")
    )

    def mark(value: str) -> Column:
        known = F.col(value).isNotNull()
        return F.max(F.when(known, F.struct("stint", "seq", value))).alias(f"{value}_mark")

    tyres = stints.groupBy(*CAR, "seq").agg(
        F.max("stint").alias("stint"), mark("compound"), mark("total_laps")
    )
    names = drivers.select(*CAR, "seq", "tla", "team")
    stacked = timed.unionByName(tyres, allowMissingColumns=True)
    return stacked.unionByName(names, allowMissingColumns=True)


def car_context(timeline: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Context as of every row of the timeline.

    ``compound_mark``/``total_laps_mark`` grow with (stint, seq), so their running
    maximum is the latest value of the highest stint that has one. ``pit_seen`` and
    ``out_seen`` are the last event that set the flag.
    """
    return running(
        timeline,
        CAR,
        "seq",
        lasts={c: F.col(c) for c in (*CONTEXT, "tla", "team")},
        maxima={
            "stint": F.col("stint"),
            "compound_mark": F.col("compound_mark"),
            "total_laps_mark": F.col("total_laps_mark"),
            "pit_seen": F.when(F.col("in_pit"), F.col("seq")),
            "out_seen": F.when(F.col("pit_out"), F.col("seq")),
        },
        span=span,
    )


def completions(timeline: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Accepted lap completions with the car's context.

    The time on a completion belongs to the lap before the one now starting. Lap
    numbers below one are dropped, and so are repeats of the number just seen.
    """
    timeline = cut_lineage(timeline, "timeline")
    context = cut_lineage(car_context(timeline, span).where("completes_lap"), "completed")
    lap = F.coalesce("lap_sent", F.coalesce("laps_completed", F.lit(0))) - 1
    numbered = context.withColumn("lap", lap).where(F.col("lap") >= 1)
    repeated = running(numbered, CAR, "seq", lags={"lap_before": F.col("lap")}, span=span)
    fresh = repeated.where(
        F.col("lap_before").isNull() | (F.col("lap_before") != F.col("lap"))
    ).drop("lap_before")
    fresh = cut_lineage(fresh, "fresh")
    off = F.lit(False)
    return running(
        fresh,
        CAR,
        "seq",
        lags={
            "prev_seq": F.col("seq"),
            "prev_in_pit": F.coalesce("in_pit", off),
            "prev_pit_out": F.coalesce("pit_out", off),
        },
        span=span,
    )


def status_as_of(laps: DataFrame, session: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Add ``track_statuses``: every status active from the last completion to this one.

    A status was active in that time if it is the present one, or if its latest
    period ended after the previous completion. Keeping the end of the latest
    period per code makes this a running maximum along the session; no lap is
    joined to a range of periods. The first lap of a car sees the present status.
    """
    laps = cut_lineage(laps, "laps")
    sent = session.where(F.col("status").isNotNull()).select("session_id", "seq", "status")
    sent = cut_lineage(sent, "statuses")
    changes = running(sent, SESSION, "seq", lags={"was": F.col("status")}, span=span)
    changes = changes.withColumn("was", F.coalesce("was", F.lit("0"))).where(
        F.col("was") != F.col("status")
    )
    stacked = laps.unionByName(changes, allowMissingColumns=True)
    ends = {f"_end_{c}": F.when(F.col("was") == c, F.col("seq")) for c in CODES}
    seen = running(
        stacked, SESSION, "seq", lasts={"status": F.col("status")}, maxima=ends, span=span
    ).where(F.col("lap").isNotNull())
    now = F.coalesce("status", F.lit("0"))
    active = [
        F.when((now == c) | (F.col(f"_end_{c}") > F.col("prev_seq")), F.lit(c)) for c in CODES
    ]
    return seen.withColumn("track_statuses", F.array_compact(F.array(*active))).drop(
        "was", "status", *ends
    )


def extract_laps(
    timing: DataFrame,
    stints: DataFrame,
    drivers: DataFrame,
    session: DataFrame,
    span: int = CHUNK_SPAN,
) -> DataFrame:
    """Lap records from feed deltas."""
    done = completions(car_timeline(timing, stints, drivers), span)
    seen = status_as_of(done, session, span)
    off = F.lit(False)

    def during(flag: str, last_set: str) -> Column:
        """Set at the previous completion already, or set since."""
        since = F.col(last_set) > F.coalesce("prev_seq", F.lit(-1))
        return F.coalesce(since, off) | F.coalesce(f"prev_{flag}", off)

    def of_stint(mark: str, value: str) -> Column:
        current = F.col(f"{mark}.stint") == F.col("stint")
        return F.when(current, F.col(f"{mark}.{value}"))

    return seen.select(
        "session_id",
        F.col("car").alias("driver"),
        F.coalesce("tla", F.lit("")).alias("tla"),
        F.coalesce("team", F.lit("")).alias("team"),
        "seq",
        "lap",
        "lap_time",
        F.coalesce(of_stint("compound_mark", "compound"), F.lit("UNKNOWN")).alias("compound"),
        F.coalesce(
            of_stint("total_laps_mark", "total_laps"), F.lit(0).cast("bigint")
        ).alias("tyre_age"),
        F.coalesce("stint", F.lit(0).cast("bigint")).alias("stint"),
        "position",
        interval_seconds(F.col("interval_text")).alias("interval"),
        F.nullif("gap_to_leader", F.lit("")).alias("gap_to_leader"),
        "track_statuses",
        during("in_pit", "pit_seen").alias("entered_pit"),
        during("pit_out", "out_seen").alias("exited_pit"),
        (F.coalesce("retired", off) | F.coalesce("stopped", off)).alias("retired"),
        "session_time",
    )


def neutralised_laps(laps: DataFrame) -> DataFrame:
    return laps.where(F.arrays_overlap("track_statuses", F.array(*map(F.lit, NEUTRALISED))))


def lap_cutoffs(session: DataFrame, wanted: list[int]) -> DataFrame:
    """``(session_id, as_of_lap, cutoff, reached)``: the event that ends each wanted lap.

    The cutoff event takes the lap count past the wanted lap and still counts.
    Without one the whole session does. ``reached`` is false where the session
    never got to the lap.
    """
    counts = session.where(F.col("lap").isNotNull()).select("session_id", "seq", "lap")
    asked = counts.withColumn("as_of_lap", F.explode(F.array(*[F.lit(x) for x in wanted])))
    return asked.groupBy("session_id", F.col("as_of_lap").cast("bigint").alias("as_of_lap")).agg(
        F.min(F.when(F.col("lap") > F.col("as_of_lap"), F.col("seq"))).alias("cutoff"),
        (F.max("lap") >= F.col("as_of_lap")).alias("reached"),
    )


def as_of_lap(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows known at each wanted lap: those up to and including its cutoff event.

    An equi-join on the session with the cutoff as residual filter. A row comes out
    once per wanted lap it was known at; the cutoff table is one row per pair.
    """
    joined = rows.join(cutoffs.where("reached"), "session_id")
    known = F.col("cutoff").isNull() | (F.col("seq") <= F.col("cutoff"))
    return joined.where(known).drop("cutoff", "reached")
