"""Board and monitoring tables (inventory group N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.operators import board, fold, laps, pace
from lapstream.plans import standins
from lapstream.plans.oracle_views import CAR_KEYS, CARS, FEED, FEED_LAPS, LAPS, MSG, last_of
from lapstream.plans.queries_feed import _events
from lapstream.plans.queries_pace import CODE, REFUSED, cleaned
from lapstream.plans.registry import query, r6
from lapstream.session import cut_lineage

TREND = """trend AS (
  SELECT session_id, driver, list(lt ORDER BY seq) AS trend FROM (
    SELECT *, round(lap_time, 3) AS lt,
      row_number() OVER (PARTITION BY session_id, driver ORDER BY seq DESC) AS back
    FROM laps WHERE lap_time IS NOT NULL AND NOT entered_pit AND NOT exited_pit
      AND status NOT IN ('4', '5', '6')) WHERE back <= 12 GROUP BY 1, 2)"""


def _millis(array):
    """Lap times as whole milliseconds, the same text in both engines."""
    whole = F.transform(array, lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


SQL_MILLIS = "list_transform(trend, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR))"


@query(
    "n1_recent_trend",
    f"""WITH {LAPS}, {TREND} SELECT session_id, driver,
      array_to_string({SQL_MILLIS}, ',') AS trend FROM trend""",
)
def recent_trend(spark, sf_dir):
    found = board.recent_laps(standins.laps(spark, sf_dir, stints=False))
    return found.select("session_id", "driver", _millis("trend").alias("trend"))


@query(
    "n2_trend_delta",
    f"""WITH {LAPS}, {TREND} SELECT session_id, driver, CASE WHEN len(trend) >= 3
      THEN round(trend[-1] - list_min(trend), 3) END AS delta FROM trend""",
)
def trend_delta(spark, sf_dir):
    found = board.with_delta(board.recent_laps(standins.laps(spark, sf_dir, stints=False)))
    return found.select("session_id", "driver", "delta")


@query(
    "n3_positions_gained",
    f"""WITH {CARS}, g AS (SELECT {CAR_KEYS}, arg_min(position, seq) AS grid FROM timing
        WHERE position IS NOT NULL GROUP BY 1, 2)
    SELECT session_id, car, grid, grid - position AS gained FROM g JOIN cars USING (session_id, car)""",
)
def positions_gained(spark, sf_dir):
    timing = fold.timing_deltas(_events(spark, sf_dir))
    state = fold.timing_state(timing).join(board.grid_positions(timing), list(fold.CAR))
    return state.select("session_id", "car", "grid", board.gained().alias("gained"))


def _bests(spark, sf_dir):
    """Car rows with a best lap, from laps: the feed stand-in carries none."""
    rows = standins.laps(spark, sf_dir, stints=False)
    return rows.groupBy("session_id", "driver").agg(F.min("lap_time").alias("best_lap_time"))


@query(
    "n4_session_fastest",
    f"""WITH {LAPS}, b AS (SELECT session_id, driver, min(lap_time) AS best FROM laps GROUP BY 1, 2)
    SELECT session_id, driver, round(min(best) OVER (PARTITION BY session_id), 6) AS session_best,
      coalesce(best <= min(best) OVER (PARTITION BY session_id), FALSE) AS fastest FROM b""",
)
def session_fastest(spark, sf_dir):
    found = board.with_fastest(_bests(spark, sf_dir))
    return found.select("session_id", "driver", r6("session_best").alias("session_best"), "fastest")


@query(
    "n5_stint_bar",
    f"""WITH {CARS}, shown AS (SELECT * FROM sall WHERE total_laps > 0 OR stint = top)
    SELECT session_id, car, string_agg(CASE compound WHEN 'SOFT' THEN 'SOF' WHEN 'HARD' THEN 'HAR'
        ELSE '---' END || ':' || total_laps || ':' || CAST(round(10000 * greatest(total_laps, 1)
          / CAST(whole AS DOUBLE)) AS BIGINT), ',' ORDER BY stint) AS bar
    FROM shown JOIN (SELECT session_id, car, sum(greatest(total_laps, 1)) AS whole FROM shown
      GROUP BY 1, 2) USING (session_id, car) GROUP BY 1, 2""",
)
def stint_bar(spark, sf_dir):
    state = fold.stint_state(fold.stint_deltas(_events(spark, sf_dir)))
    part = F.transform(
        board.stint_bar(F.col("stints")),
        lambda s: F.concat_ws(
            ":",
            s["code"],
            s["laps"].cast("string"),
            F.round(s["share"] * 10000).cast("bigint").cast("string"),
        ),
    )
    return state.select("session_id", "car", F.array_join(part, ",").alias("bar"))


@query(
    "n6_board_rows",
    f"""WITH {FEED_LAPS}, {CARS[CARS.index("tstate AS"):]}, ftrend AS (
      SELECT session_id, driver AS car, list(lt ORDER BY seq) AS trend FROM (
        SELECT *, round(lap_time, 3) AS lt,
          row_number() OVER (PARTITION BY session_id, driver ORDER BY seq DESC) AS back
        FROM flaps WHERE lap_time IS NOT NULL AND NOT entered_pit AND NOT exited_pit
          AND NOT regexp_matches(statuses, '[456]')) WHERE back <= 12 GROUP BY 1, 2)
    SELECT session_id, car, position, coalesce(nullif(tla, ''), car) AS code,
      round(last_lap_time, 3) AS last, gap_to_leader AS gap, ival AS "interval", in_pit,
      retired AS out, coalesce(len(trend), 0) AS trend_laps,
      CASE WHEN len(trend) >= 3 THEN round(trend[-1] - list_min(trend), 3) END AS delta
    FROM cars LEFT JOIN ftrend USING (session_id, car) WHERE position IS NOT NULL OR tla <> ''""",
)
def board_rows(spark, sf_dir):
    # Payloads are opened once; state, laps and grid all read the opened rows.
    events = _events(spark, sf_dir)
    timing = cut_lineage(fold.timing_deltas(events), "timing")
    stints = cut_lineage(fold.stint_deltas(events), "stints")
    drivers = cut_lineage(fold.driver_deltas(events), "drivers")
    cars = fold.car_state(
        fold.timing_state(timing), fold.stint_state(stints), fold.driver_state(drivers)
    )
    found_laps = laps.extract_laps(
        timing, stints, drivers, fold.session_deltas(events)
    )
    trends = board.recent_laps(found_laps)
    found = board.board_rows(cars, trends, board.grid_positions(timing))
    return found.select(
        "session_id", "car", "position", "code", "last", "gap", "interval", "in_pit", "out",
        F.size("trend").alias("trend_laps"), "delta",
    )


@query(
    "n7_model_summary",
    f"""WITH RECURSIVE {REFUSED}, counted AS (SELECT session_id, count(*) AS clean_laps FROM clean GROUP BY 1),
      runs AS (SELECT session_id, count(DISTINCT (driver, stint)) AS stints
        FROM rows JOIN fits USING (session_id) GROUP BY 1),
      rates AS (SELECT session_id, string_agg({CODE} || ':' || CAST(CAST(round(degradation * 10000) AS BIGINT)
        AS VARCHAR), ',' ORDER BY degradation DESC, compound) AS wear FROM wear GROUP BY 1)
    SELECT session_id, clean_laps, stints, round(trend, 4) AS trend, round(residual_std, 3) AS residual,
      round(r_squared, 3) AS r2, wear
    FROM fitted JOIN counted USING (session_id) JOIN runs USING (session_id) JOIN rates USING (session_id)
    WHERE session_id NOT IN (SELECT session_id FROM refused)""",
)
def model_summary(spark, sf_dir):
    clean = cut_lineage(cleaned(spark, sf_dir), "clean")
    found = board.model_summary(pace.fit_pace(clean), clean)
    rate = F.transform(
        "degradation",
        lambda e: F.concat(e["code"], F.lit(":"), F.round(e["rate"] * 10000).cast("bigint").cast("string")),
    )
    return found.withColumn("wear", F.array_join(rate, ",")).drop("degradation", "warnings")


def _frames(spark, sf_dir):
    """Events as frames: lag is k milliseconds, decode time the value in microseconds."""
    return standins.feed(spark, sf_dir).select(
        "session_id",
        "seq",
        F.col("ts").alias("arrival"),
        F.lit(1).cast("bigint").alias("events"),
        F.when(F.col("topic") != "view", F.col("k") / 1000).alias("lag"),
        (F.col("value") / 1e6).alias("decode"),
    )


def _sql_nearest(value: str) -> str:
    return f"""SELECT session_id, max(CASE WHEN idx = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))
        THEN v END) AS p50,
      max(CASE WHEN idx = least(n - 1, CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT)) THEN v END)
        AS p99, avg(v) AS mean
      FROM (SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY v) - 1 AS idx,
          count(*) OVER (PARTITION BY session_id) AS n
        FROM (SELECT session_id, {value} AS v, row_number() OVER (PARTITION BY session_id
            ORDER BY seq DESC) AS back FROM frames WHERE {value} IS NOT NULL)
        WHERE back <= 2000) GROUP BY session_id"""


FRAMES = """frames AS (SELECT session_id, seq, ts,
  CASE WHEN topic <> 'view' THEN k / CAST(1000 AS DOUBLE) END AS lag,
  value / CAST(1000000 AS DOUBLE) AS decode FROM feed)"""


@query(
    "n8_latency_summary",
    f"""WITH {FEED}, {FRAMES}, a AS ({_sql_nearest("lag")}), b AS ({_sql_nearest("decode")}),
      t AS (SELECT session_id, count(*) AS frames, count(*) AS events FROM frames GROUP BY 1)
    SELECT session_id, frames, events, round(a.p50, 6) AS lag_p50, round(a.p99, 6) AS lag_p99,
      round(a.mean, 6) AS lag_mean, round(b.p50 * 1000, 6) AS decode_p50,
      round(b.p99 * 1000, 6) AS decode_p99
    FROM t LEFT JOIN a USING (session_id) LEFT JOIN b USING (session_id)""",
)
def latency_summary(spark, sf_dir):
    found = board.latency_summary(_frames(spark, sf_dir))
    return found.select(
        "session_id", "frames", "events",
        *[r6(c).alias(c) for c in ("lag_p50", "lag_p99", "lag_mean")],
        *[F.round(F.col(c) * 1000, 6).alias(c) for c in ("decode_p50", "decode_p99")],
    )


@query(
    "n9_message_lag",
    f"""WITH {FEED} SELECT seq, round(k / CAST(1000 AS DOUBLE), 6) AS lag FROM feed""",
)
def message_lag(spark, sf_dir):
    from lapstream.sources.frames import message_lag as lag

    rows = standins.feed(spark, sf_dir)
    late = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 1000)
    return lag(rows.withColumn("arrival", late)).select("seq", r6("lag").alias("lag"))


@query(
    "n10_silence_segments",
    f"""WITH {FEED}, g AS (SELECT session_id, seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (
        PARTITION BY session_id ORDER BY seq) > 7200000000 AS silent FROM feed)
    SELECT session_id, seq, CAST(sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (
      PARTITION BY session_id ORDER BY seq) AS BIGINT) AS segment FROM g""",
)
def silence_segments(spark, sf_dir):
    """The stand-in feed is slow, so two hours of silence split it, not a minute."""
    frames = standins.feed(spark, sf_dir).select("session_id", "seq", F.col("ts").alias("arrival"))
    found = board.silence_segments(frames, seconds=7200.0)
    return found.select("session_id", "seq", "segment")


@query(
    "b4_is_gap",
    f"""WITH {MSG} SELECT session_id, car, seq, trim(coalesce(ival, '')) <> '' AND
      upper(trim(coalesce(ival, ''))) NOT LIKE 'LAP%' AS is_gap FROM timing""",
)
def is_gap(spark, sf_dir):
    from lapstream.functions.text import is_gap as gap

    deltas = fold.timing_deltas(_events(spark, sf_dir))
    return deltas.select("session_id", "car", "seq", gap(F.col("interval_text")).alias("is_gap"))


@query(
    "n11_session_row",
    f"""WITH {MSG}, s AS (SELECT session_id, coalesce({last_of("name")}, '') AS session_name,
      coalesce({last_of("short_name")}, {last_of("location")}, '') AS circuit,
      coalesce({last_of("lap")}, 0) AS lap, coalesce({last_of("total_laps")}, 0) AS total_laps,
      {last_of("air")} AS air_temp, {last_of("track")} AS track_temp,
      coalesce({last_of("rain")}, FALSE) AS rainfall,
      coalesce({last_of("status")}, '0') IN ('4', '5', '6') AS neutralised FROM sess GROUP BY session_id)
    SELECT *, CASE WHEN total_laps > 0 THEN round(lap / total_laps, 4) ELSE 0 END AS progress,
      greatest(0, total_laps - lap) AS laps_remaining FROM s""",
)
def session_row(spark, sf_dir):
    events = standins.feed_events(spark, sf_dir)
    session = fold.session_state(fold.session_deltas(events))
    rows = board.session_rows(session, fold.timing_state(fold.timing_deltas(events)))
    return rows.drop("track_status", "session_best")
