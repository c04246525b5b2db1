"""Board and monitoring tables: what a timing screen shows, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.functions.race import laps_remaining, progress
from lapstream.functions.text import compound_short, is_gap, is_neutralised, track_status_name
from lapstream.operators.clean import was_neutralised
from lapstream.operators.fold import CAR, order_columns
from lapstream.operators.scan import CHUNK_SPAN, running
from lapstream.session import cut_lineage

# Laps in a trend, least laps for a delta, latency sample, silence.
TREND_LAPS = 12
DELTA_LAPS = 3
LATENCY_SAMPLES = 2000
SILENCE_SECONDS = 60.0


def recent_laps(laps: DataFrame, keys: Sequence[str] = ("session_id", "driver"), limit: int = TREND_LAPS) -> DataFrame:
    """Last timed green-flag laps per car without a pit visit, as an ordered array.

    The row limit is taken below the shuffle too (a group limit), so a hot car
    sends a dozen rows per task.
    """
    counts = (
        F.col("lap_time").isNotNull()
        & ~F.col("entered_pit")
        & ~F.col("exited_pit")
        & ~was_neutralised()
    )
    latest = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    kept = (
        laps.where(counts)
        .select(*keys, "seq", F.round("lap_time", 3).alias("lap_time"))
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= limit)
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lap_time")))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda e: e["lap_time"]).alias("trend"))


def with_delta(trends: DataFrame) -> DataFrame:
    """Latest lap against the best of the trend, once there are three."""
    latest = F.try_element_at("trend", F.lit(-1))
    return trends.withColumn(
        "delta",
        F.when(F.size("trend") >= DELTA_LAPS, F.round(latest - F.array_min("trend"), 3)),
    )


def grid_positions(timing: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """First position a car was ever classified in; for a race that is the grid."""
    placed = timing.where(F.col("position").isNotNull())
    return placed.groupBy(*keys).agg(F.min_by("position", "seq").alias("grid"))


def gained() -> Column:
    """Places won since the start; 0 while either end is unknown."""
    known = (F.coalesce("grid", F.lit(0)) > 0) & (F.coalesce("position", F.lit(0)) > 0)
    return F.when(known, F.col("grid") - F.col("position")).otherwise(0)


def with_fastest(cars: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Add the session's best lap and whether the car holds it.

    An aggregate joined back, not a window: a session is never gathered whole.
    """
    timed = F.when(F.col("best_lap_time") > 0, F.col("best_lap_time"))
    best = cars.groupBy(*keys).agg(F.min(timed).alias("session_best"))
    return cars.join(best, list(keys), "left").withColumn(
        "fastest", F.coalesce(F.col("best_lap_time") <= F.col("session_best"), F.lit(False))
    )


def stint_bar(stints: Column) -> Column:
    """Stints with laps, and the last one always: code, laps and share of the bar."""
    last = F.size(stints) - 1
    shown = F.filter(stints, lambda s, i: (s["total_laps"] > 0) | (i == last))

    def width(s: Column) -> Column:
        return F.greatest(s["total_laps"], F.lit(1))

    whole = F.aggregate(shown, F.lit(0).cast("bigint"), lambda acc, s: acc + width(s))
    return F.transform(
        shown,
        lambda s: F.struct(
            compound_short(s["compound"]).alias("code"),
            s["total_laps"].alias("laps"),
            (width(s) / whole).alias("share"),
        ),
    )


def board_rows(cars: DataFrame, trends: DataFrame, grids: DataFrame) -> DataFrame:
    """One row per car for the screen, in running order.

    ``cars`` is the car state with ``first_seen``; trends are keyed by driver.
    """
    trend = with_delta(trends).withColumnRenamed("driver", "car")
    keys = list(CAR)
    shown = cars.where(F.col("position").isNotNull() | (F.col("tla") != ""))
    filled = with_fastest(shown).join(trend, keys, "left").join(grids, keys, "left")
    none = F.array().cast("array<double>")
    return filled.orderBy("session_id", *order_columns()).select(
        "session_id",
        "car",
        "position",
        F.coalesce(F.nullif("tla", F.lit("")), F.col("car")).alias("code"),
        "team",
        compound_short(F.col("compound")).alias("tyre"),
        "tyre_age",
        F.round("last_lap_time", 3).alias("last"),
        F.round("best_lap_time", 3).alias("best"),
        "fastest",
        F.when(is_gap(F.col("gap_to_leader")), F.col("gap_to_leader")).alias("gap"),
        F.when(is_gap(F.col("interval_text")), F.col("interval_text")).alias("interval"),
        F.col("pit_count").alias("stops"),
        "in_pit",
        (F.col("retired") | F.col("stopped")).alias("out"),
        gained().cast("bigint").alias("gained"),
        stint_bar(F.coalesce("stints", F.array().cast(STINTS))).alias("stint_bar"),
        F.coalesce("trend", none).alias("trend"),
        "delta",
    )


STINTS = (
    "array<struct<stint:bigint,compound:string,is_new:boolean,start_laps:bigint,total_laps:bigint>>"
)


def model_summary(fits: DataFrame, clean: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """What a usable pace fit says, wear by rate; refused fits have no row."""
    counted = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("clean_laps"))
    by_rate = F.array_sort(
        F.transform(
            F.map_entries("degradation"),
            lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("c")),
        )
    )
    wear = F.transform(
        by_rate,
        lambda e: F.struct(compound_short(e["c"]).alias("code"), F.round(-e["o"], 4).alias("rate")),
    )
    return (
        fits.where(F.size("refusals") == 0)
        .join(counted, list(keys))
        .select(
            *keys,
            "clean_laps",
            F.col("n_stints").alias("stints"),
            F.round("trend", 4).alias("trend"),
            F.round("residual_std", 3).alias("residual"),
            F.round("r_squared", 3).alias("r2"),
            wear.alias("degradation"),
            "warnings",
        )
    )


def _nearest(samples: DataFrame, value: str, order: str, name: str, limit: int) -> DataFrame:
    """p50 and p99 of the latest samples, by nearest rank, per session."""
    recent = Window.partitionBy("session_id").orderBy(F.desc(order))
    kept = (
        samples.where(F.col(value).isNotNull())
        .select("session_id", order, value)
        .withColumn("_back", F.row_number().over(recent))
        .where(F.col("_back") <= limit)
    )
    # At most ``limit`` rows per session from here on.
    ranked = Window.partitionBy("session_id").orderBy(value)
    sized = kept.withColumns(
        {
            "_at": F.row_number().over(ranked) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy("session_id")),
        }
    )

    def at(share: float) -> Column:
        index = F.least(F.col("_n") - 1, F.floor(F.col("_n") * share))
        return F.max(F.when(F.col("_at") == index, F.col(value)))

    return sized.groupBy("session_id").agg(
        at(0.50).alias(f"{name}_p50"), at(0.99).alias(f"{name}_p99"), F.avg(value).alias(f"{name}_mean")
    )


def latency_summary(frames: DataFrame, order: str = "seq", limit: int = LATENCY_SAMPLES) -> DataFrame:
    """Frame and event counts with lag and decode times of the latest samples.

    Needs ``session_id, events, lag, decode`` per frame. Without samples a
    percentile is 0.
    """
    totals = frames.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("events").alias("events")
    )
    out = totals
    for value in ("lag", "decode"):
        out = out.join(_nearest(frames, value, order, value, limit), "session_id", "left")
    zero = F.lit(0.0)
    shown = ("lag_p50", "lag_p99", "lag_mean", "decode_p50", "decode_p99")
    return out.select(
        "session_id", "frames", "events", *[F.coalesce(c, zero).alias(c) for c in shown]
    )


def session_rows(session: DataFrame, cars: DataFrame) -> DataFrame:
    """One row per session: lap and progress, track status, weather, fastest lap so far.

    ``session`` is the final or as-of session state, ``cars`` the timing state of its cars.
    """
    best = cars.groupBy("session_id").agg(F.min("best_lap_time").alias("session_best"))
    return session.join(best, "session_id", "left").select(
        "session_id",
        "session_name",
        "circuit",
        "lap",
        "total_laps",
        progress(F.col("lap"), F.col("total_laps")).alias("progress"),
        laps_remaining(F.col("lap"), F.col("total_laps")).alias("laps_remaining"),
        track_status_name(F.col("status")).alias("track_status"),
        is_neutralised(F.col("status")).alias("neutralised"),
        "air_temp",
        "track_temp",
        "rainfall",
        F.round("session_best", 3).alias("session_best"),
    )


def silence_segments(
    frames: DataFrame,
    order: str = "seq",
    seconds: float = SILENCE_SECONDS,
    span: int = CHUNK_SPAN,
) -> DataFrame:
    """Number the stretches of a feed between silences longer than ``seconds``."""
    micros = F.unix_micros(F.col("arrival").cast("timestamp"))
    timed = frames.withColumn("_at", micros)
    gaps = running(timed, ["session_id"], order, lags={"_before": F.col("_at")}, span=span)
    opened = (F.col("_at") - F.col("_before")) > int(seconds * 1_000_000)
    marked = gaps.withColumn("_new", F.coalesce(opened, F.lit(False)).cast("bigint"))
    marked = cut_lineage(marked, "gaps")
    numbered = running(
        marked, ["session_id"], order, sums={"segment": F.col("_new")}, span=span
    )
    return numbered.drop("_at", "_before", "_new")
