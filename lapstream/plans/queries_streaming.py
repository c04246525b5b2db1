"""Streaming versions (inventory group O), run to the end over derived messages.

Messages are written as files in seq order into the shared folder and read as a
stream, several micro-batches long.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.plans import standins
from lapstream.plans.oracle_views import CARS, FEED, FEED_LAPS, MSG
from lapstream.plans.queries_board import FRAMES, _frames
from lapstream.plans.queries_clean import BEST
from lapstream.plans.queries_pace import REFUSED
from lapstream.plans.registry import joined, query, r6
from lapstream.session import cut_lineage, scratch_path
from lapstream.streaming import advice, laps, run, state

STEPS = 3


def _message_files(spark, sf_dir, label):
    """Message files that follow each other in seq, for ``STEPS`` micro-batches or more."""
    path = scratch_path(spark, label)
    rows = standins.messages(spark, sf_dir, lambda events: run.in_order(events, "event_id", STEPS)).drop("k", "car")
    run.write_in_order(rows, path)
    return path, rows.schema


def _opened(raw):
    return raw.select(
        "session_id", "seq", "topic", F.try_parse_json("payload_json").alias("payload"), "ts"
    )


def _stream(spark, path, schema):
    """Oldest files first, a few per micro-batch."""
    return _opened(
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", run.BATCH_FILES)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def _settle(*queries):
    for each in queries:
        each.awaitTermination()


@query(
    "o1_stream_car_state",
    f"""WITH {CARS} SELECT session_id, car, position, laps_completed, gap_to_leader, in_pit, pit_out,
      retired FROM tstate""",
)
def stream_car_state(spark, sf_dir):
    path, schema = _message_files(spark, sf_dir, "o1")
    out = scratch_path(spark, "o1-out")
    states = state.car_states(_stream(spark, path, schema))
    _settle(run.update_to(states, out, scratch_path(spark, "o1-log")))
    found = run.latest_updates(spark, out, ["session_id", "car"])
    return found.select(
        "session_id", "car", "position", "laps_completed", "gap_to_leader", "in_pit", "pit_out",
        "retired",
    )


LAP_SQL = f"""WITH {FEED_LAPS} SELECT session_id, driver, seq, lap, round(lap_time, 6) AS lap_time,
  tla, compound, tyre_age, stint, position, round(gap_s, 6) AS "interval", statuses, entered_pit,
  exited_pit, retired FROM flaps"""


def _shown(found):
    return found.select(
        "session_id", "driver", "seq", "lap", r6("lap_time").alias("lap_time"), "tla", "compound",
        "tyre_age", "stint", "position", r6("interval").alias("interval"),
        joined("track_statuses").alias("statuses"), "entered_pit", "exited_pit", "retired",
    )


def _run_laps(spark, path, schema, out, log):
    run.use_rocksdb(spark)
    found = laps.stream_laps(_stream(spark, path, schema), shards=4)
    _settle(run.append_to(found, out, log))
    return spark.read.schema(found.schema).parquet(out)


@query("o2_stream_laps", LAP_SQL)
def stream_laps(spark, sf_dir):
    path, schema = _message_files(spark, sf_dir, "o2")
    out, log = scratch_path(spark, "o2-out"), scratch_path(spark, "o2-log")
    return _shown(_run_laps(spark, path, schema, out, log))


@query(
    "o3_stream_census",
    f"""WITH {MSG} SELECT session_id, topic, epoch_us(date_trunc('day', ts)) AS day, count(*) AS events
      FROM msg GROUP BY 1, 2, 3""",
)
def stream_census(spark, sf_dir):
    path, schema = _message_files(spark, sf_dir, "o3")
    out = scratch_path(spark, "o3-out")
    census = state.topic_census(_stream(spark, path, schema), "1 day", "30 days")
    _settle(run.update_to(census, out, scratch_path(spark, "o3-log")))
    found = run.latest_updates(spark, out, ["session_id", "window_start", "topic"])
    return found.select(
        "session_id", "topic", F.unix_micros("window_start").alias("day"), "events"
    )


@query(
    "o3_stream_latency",
    f"""WITH {FEED}, {FRAMES}, placed AS (
      SELECT session_id, date_trunc('day', ts) AS day, lag, count(lag) OVER (PARTITION BY session_id, date_trunc('day', ts)) AS n,
        row_number() OVER (PARTITION BY session_id, date_trunc('day', ts) ORDER BY lag NULLS LAST) AS place
      FROM frames)
    SELECT session_id, epoch_us(day) AS day, count(*) AS frames,
      round(max(CASE WHEN place = ceil(n * CAST(0.5 AS DOUBLE)) THEN lag END), 6) AS lag_p50,
      round(max(CASE WHEN place = ceil(n * CAST(0.99 AS DOUBLE)) THEN lag END), 6) AS lag_p99
    FROM placed GROUP BY 1, 2""",
)
def stream_latency(spark, sf_dir):
    path = scratch_path(spark, "o3b")
    rows = _frames(spark, sf_dir)
    rows.write.parquet(path)
    out = scratch_path(spark, "o3b-out")
    stream = spark.readStream.schema(rows.schema).parquet(path)
    _settle(run.update_to(state.latency(stream, "1 day", "30 days"), out, scratch_path(spark, "o3b-log")))
    found = run.latest_updates(spark, out, ["session_id", "window_start"])
    return found.select(
        "session_id", F.unix_micros("window_start").alias("day"), "frames", *[r6(c).alias(c) for c in ("lag_p50", "lag_p99")]
    )


# A fit key is the session with the step, so the SQL of the classes and fits serves as it is.
STEPPED = f"""{BEST.split("best AS (")[0].rstrip().rstrip(",")},
bounds AS (SELECT min(seq) AS low, (max(seq) - min(seq)) // {STEPS} + 1 AS width FROM laps),
dealt AS (SELECT l.*, (seq - low) // width AS step FROM laps l CROSS JOIN bounds),
came AS (SELECT DISTINCT session_id AS session, step FROM dealt),
held AS (SELECT d.* REPLACE (d.session_id || '@' || c.step AS session_id), c.session, c.step AS upto
  FROM dealt d JOIN came c ON d.session_id = c.session AND d.step <= c.step),
best AS ({BEST.split("best AS (")[1].replace("FROM laps", "FROM held", 1).replace("FROM laps l", "FROM held l", 1)}"""


@query(
    "o4_advice_refresh",
    f"""WITH RECURSIVE {REFUSED.replace(BEST, STEPPED)},
got AS (SELECT session_id, session, upto, max(lap) AS lap FROM held GROUP BY 1, 2, 3),
further AS (
  SELECT *, coalesce(lap > lag(lap) OVER (PARTITION BY session ORDER BY upto), TRUE) AS more FROM got),
sizes AS (SELECT session_id, count(*) AS n FROM clean GROUP BY 1)
SELECT g.session AS session_id, g.lap, coalesce(s.n, 0) AS clean_laps,
  CASE WHEN whole THEN round(trend, 5) END AS trend, round(residual_std, 5) AS residual_std,
  CASE WHEN f.session_id IS NULL THEN 'not enough clean laps' ELSE coalesce(refusals, '') END AS refused,
  f.session_id IS NOT NULL AND refusals IS NULL AS usable
FROM further g LEFT JOIN sizes s USING (session_id) LEFT JOIN fitted f USING (session_id)
  LEFT JOIN refused r USING (session_id)
WHERE more""",
)
def advice_refresh(spark, sf_dir):
    """Laps arriving in steps of seq; advice once per session and lap reached. Only a fit of
    full rank has numbers to name, as in the query of refused fits."""
    path = scratch_path(spark, "o4")
    rows = standins.laps(spark, sf_dir)
    keep = cut_lineage(rows.drop("value", "k", "is_last", "status", "circuit", "total_laps"), "o4-rows")
    low, high = keep.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // STEPS + 1
    out, known, log = (scratch_path(spark, x) for x in ("o4-out", "o4-laps", "o4-log"))
    write = advice.refresher(known, out)
    for step in range(STEPS):
        part = keep.where((F.col("seq") >= low + step * width) & (F.col("seq") < low + (step + 1) * width))
        part.write.mode("append").parquet(path)
        # What is new since the last run is one micro-batch.
        _settle(run.each_batch(spark.readStream.schema(keep.schema).parquet(path), write, log))
    whole = ~F.array_contains("refused", "effects not identified")
    return spark.read.parquet(out).select(
        "session_id", "lap", "clean_laps", F.when(whole, F.round("trend", 5)).alias("trend"),
        F.round("residual_std", 5).alias("residual_std"),
        F.when(whole, joined("refused")).otherwise("effects not identified").alias("refused"), "usable",
    )


@query("o5_catch_up_then_tail", LAP_SQL)
def catch_up_then_tail(spark, sf_dir):
    """History first, then what arrived later, from the same checkpoint."""
    path, schema = _message_files(spark, sf_dir, "o5")
    live = scratch_path(spark, "o5-live")
    out, log = scratch_path(spark, "o5-out"), scratch_path(spark, "o5-log")
    rows = spark.read.schema(schema).parquet(path)
    middle = standins.feed(spark, sf_dir).agg(F.avg("seq")).first()[0]
    run.write_in_order(run.in_order(rows.where(F.col("seq") < middle), "seq"), f"{live}/part=history")
    _run_laps(spark, live, schema, out, log)
    run.write_in_order(run.in_order(rows.where(F.col("seq") >= middle), "seq"), f"{live}/part=live")
    return _shown(_run_laps(spark, live, schema, out, log))
