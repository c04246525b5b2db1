"""Streaming state folds and monitors: native streaming aggregates.

Latest state is a maximum by ``seq``, so it is an ordinary aggregate: combined
before the shuffle, kept in the state store, and a late row with a lower ``seq``
never overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.operators import fold

#: Rank error of a lag percentile is one in so many.
LATENCY_ACCURACY = 10_000


def car_states(events: DataFrame) -> DataFrame:
    """Timing state per car; start it in update mode for changed rows only."""
    return fold.timing_state(fold.timing_deltas(events))


def session_states(events: DataFrame) -> DataFrame:
    return fold.session_state(fold.session_deltas(events))


def topic_census(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per topic and time window. Unstamped snapshots have no window."""
    stamped = events.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        stamped.withWatermark("ts", late)
        .groupBy("session_id", F.window("ts", width).alias("window"), "topic")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            "session_id",
            F.col("window.start").alias("window_start"),
            "topic",
            "events",
        )
    )


def latency(
    frames: DataFrame, width: str = "1 minute", late: str = "10 minutes", accuracy: int = LATENCY_ACCURACY
) -> DataFrame:
    """Lag percentiles per time window, from a mergeable quantile sketch kept as state.

    A percentile is a lag that was seen, whose rank among the n lags of the window is within
    n / ``accuracy`` of ceil(share * n); with fewer than ``accuracy`` lags it is the lag of that
    rank. Frames without a lag only count as frames; a window without any lag has NULLs.
    """
    timed = frames.withColumn("arrival", F.col("arrival").cast("timestamp"))
    return (
        timed.withWatermark("arrival", late)
        .groupBy("session_id", F.window("arrival", width).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.percentile_approx("lag", 0.5, accuracy).alias("lag_p50"),
            F.percentile_approx("lag", 0.99, accuracy).alias("lag_p99"),
        )
        .select(
            "session_id", F.col("window.start").alias("window_start"), "frames", "lag_p50", "lag_p99"
        )
    )


def connections(frames: DataFrame, silence: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Connection segments: a session window closes after a silence."""
    timed = frames.withColumn("arrival", F.col("arrival").cast("timestamp"))
    return (
        timed.withWatermark("arrival", late)
        .groupBy("session_id", F.session_window("arrival", silence).alias("window"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .select(
            "session_id",
            F.col("window.start").alias("opened"),
            F.col("window.end").alias("closed"),
            "frames",
        )
    )
