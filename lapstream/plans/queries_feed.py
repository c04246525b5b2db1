"""State folding and lap extraction over derived feed messages (groups C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.functions import race, text
from lapstream.operators import fold, laps, tree
from lapstream.operators.clean import was_neutralised
from lapstream.plans import standins
from lapstream.plans.oracle_views import CAR_KEYS, CARS, FEED_LAPS, MSG, last_of, last_so_far
from lapstream.plans.registry import joined, query, r6
from lapstream.session import cut_lineage
from lapstream.sources import recordings


def _events(spark, sf_dir):
    return standins.feed_events(spark, sf_dir)


def _cars(spark, sf_dir):
    events = _events(spark, sf_dir)
    return fold.car_state(
        fold.timing_state(fold.timing_deltas(events)),
        fold.stint_state(fold.stint_deltas(events)),
        fold.driver_state(fold.driver_deltas(events)),
    )


def feed_laps(spark, sf_dir):
    events = _events(spark, sf_dir)
    return laps.extract_laps(
        fold.timing_deltas(events),
        fold.stint_deltas(events),
        fold.driver_deltas(events),
        fold.session_deltas(events),
    )


@query(
    "c1_fold_latest",
    f"""WITH {MSG} SELECT session_id, car, {last_of("position")} AS position,
      {last_of("laps_completed")} AS laps_completed FROM timing GROUP BY session_id, car""",
)
def fold_latest(spark, sf_dir):
    deltas = fold.timing_deltas(_events(spark, sf_dir))
    fields = ("position", "laps_completed")
    return fold.last_states(deltas, fold.CAR, "seq", {f: F.col(f) for f in fields})


def _text(value: str) -> str:
    return f"'\"' || ({value}) || '\"'"


_CAR = "'Lines/' || car || '/'"
_STINT = f"{_CAR} || 'Stints/' || k // 34 || '/'"
#: Every field that a message can carry: which messages, path, and JSON of the value (NULL where not sent).
MESSAGE_FIELDS = (
    ("etype = 'click'", f"{_CAR} || 'Position'", _text("CASE WHEN k % 5 <> 4 THEN CASE WHEN k < 3 THEN '' ELSE CAST(k % 20 + 1 AS VARCHAR) END END")),
    ("etype = 'click'", f"{_CAR} || 'GapToLeader'", _text("CASE WHEN k % 4 = 1 THEN '' WHEN k % 4 <> 0 THEN '+' || CAST(value AS VARCHAR) END")),
    ("etype = 'click'", f"{_CAR} || 'IntervalToPositionAhead/Value'", _text("CASE k % 3 WHEN 0 THEN '1L' WHEN 1 THEN '+' || CAST(value AS VARCHAR) END")),
    ("etype = 'click'", f"{_CAR} || 'InPit'", "CASE k % 10 WHEN 7 THEN 'true' WHEN 8 THEN 'false' END"),
    ("etype = 'click'", f"{_CAR} || 'PitOut'", "CASE k % 10 WHEN 8 THEN 'true' WHEN 9 THEN 'false' END"),
    ("etype = 'click'", f"{_CAR} || 'Retired'", _text("CASE k WHEN 50 THEN 'true' WHEN 51 THEN 'false' END")),
    ("etype = 'purchase'", f"{_CAR} || 'NumberOfLaps'", "CASE WHEN k % 3 <> 0 THEN CAST(k // 10 AS VARCHAR) END"),
    ("etype = 'purchase'", f"{_CAR} || 'LastLapTime/Value'", _text("CASE WHEN k < 5 THEN '' ELSE '1:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k AS VARCHAR), 3, '0') END")),
    ("etype = 'purchase'", f"{_CAR} || 'Sectors/' || k % 4 || '/Value'", _text("CAST(20 + k % 10 AS VARCHAR) || '.5'")),
    ("topic = 'TimingAppData'", f"{_STINT} || 'Compound'", _text("CASE k % 4 WHEN 1 THEN 'SOFT' WHEN 2 THEN 'hard' WHEN 3 THEN 'TEST_UNKNOWN' END")),
    ("topic = 'TimingAppData'", f"{_STINT} || 'New'", _text("CASE WHEN k % 2 = 0 THEN 'false' END")),
    ("topic = 'TimingAppData'", f"{_STINT} || 'TotalLaps'", "CASE WHEN k % 5 <> 0 THEN CAST(k % 30 AS VARCHAR) END"),
    ("topic = 'TrackStatus'", "'Status'", _text("CAST(k % 9 AS VARCHAR)")),
    ("topic = 'LapCount'", "'CurrentLap'", _text("CASE WHEN k < 8 THEN '' ELSE CAST(k AS VARCHAR) END")),
    ("topic = 'LapCount'", "'TotalLaps'", "CASE WHEN k % 8 = 0 THEN '70' END"),
    ("topic = 'WeatherData'", "'AirTemp'", _text("CAST(k % 10 - 1 AS VARCHAR)")),
    ("topic = 'WeatherData'", "'TrackTemp'", _text("CASE WHEN k > 50 THEN 'x' ELSE CAST(k AS VARCHAR) END")),
    ("topic = 'WeatherData'", "'Rainfall'", _text("CASE WHEN k % 8 = 1 THEN '1' WHEN k % 16 = 5 THEN '0' END")),
    ("topic = 'DriverList'", "car || '/Tla'", _text("CASE WHEN k < 10 THEN '' ELSE 'T' || k END")),
    ("topic = 'DriverList'", "car || '/FullName'", _text("CASE WHEN k % 8 <> 2 THEN 'Car ' || k END")),
    ("topic = 'DriverList'", "car || '/BroadcastName'", _text("'B' || k")),
    ("topic = 'DriverList'", "car || '/TeamName'", _text("'Team ' || k % 10")),
    ("topic = 'SessionInfo'", "'Name'", _text("'Race ' || k")),
    ("topic = 'SessionInfo'", "'Type'", _text("'Race'")),
    ("topic = 'SessionInfo'", "'Meeting/Location'", _text("'L' || k")),
    ("topic = 'SessionInfo'", "'Meeting/Circuit/ShortName'", _text("CASE WHEN k % 8 <> 3 THEN 'C' || k END")),
)
SENT = " UNION ALL ".join(
    f"SELECT session_id, topic, seq, {path} AS path, {value} AS value FROM msg WHERE {which}"
    for which, path, value in MESSAGE_FIELDS
)


@query(
    "c1_fold_tree",
    f"""WITH {MSG}, sent AS ({SENT})
    SELECT session_id, topic, path, arg_max(value, seq) AS value FROM sent WHERE value IS NOT NULL
    GROUP BY session_id, topic, path""",
)
def fold_tree(spark, sf_dir):
    """Leaves of the trees of all topics after every message."""
    leaves = tree.fold_tree(_events(spark, sf_dir)).where("kind = 'scalar'")
    return leaves.select("session_id", "topic", F.array_join("path", "/").alias("path"), "value")


@query(
    "c2_list_patches",
    f"""WITH {MSG}, r AS (SELECT session_id, max(CASE WHEN k % 7 = 0 THEN seq END) AS base FROM msg
        GROUP BY session_id HAVING base IS NOT NULL),
      w AS (SELECT m.session_id, seq, k, unnest(CASE WHEN k % 7 = 0 THEN [0, 1] ELSE [k % 5] END) AS place
        FROM msg m JOIN r ON m.session_id = r.session_id AND m.seq >= base),
      e AS (SELECT session_id, place, arg_max(k, seq) AS v FROM w GROUP BY 1, 2),
      n AS (SELECT session_id, CAST(unnest(generate_series(0, max(place))) AS BIGINT) AS place FROM e
        GROUP BY session_id)
    SELECT session_id, string_agg(coalesce(CAST(v AS VARCHAR), 'null'), ',' ORDER BY place) AS elements
    FROM n LEFT JOIN e USING (session_id, place) GROUP BY session_id""",
)
def list_patches(spark, sf_dir):
    """A list that is replaced now and then and patched by index in between."""
    k = F.col("k")
    whole = F.to_json(F.struct(F.array(k, k).alias("S")))
    patch = F.to_json(F.struct(F.create_map((k % 5).cast("string"), k).alias("S")))
    rows = standins.messages(spark, sf_dir).select(
        "session_id",
        "seq",
        F.lit("List").alias("topic"),
        F.parse_json(F.when(k % 7 == 0, whole).otherwise(patch)).alias("payload"),
    )
    lists = tree.list_arrays(tree.fold_tree(rows))
    shown = F.transform("elements", lambda e: F.coalesce(e, F.lit("null")))
    return lists.select("session_id", F.array_join(shown, ",").alias("elements"))


@query(
    "c3_fold_as_of",
    f"""WITH {MSG} SELECT session_id, car, seq, {last_so_far("position", CAR_KEYS)} AS position,
      coalesce({last_so_far("in_pit", CAR_KEYS)}, FALSE) AS in_pit,
      nullif({last_so_far("gap", CAR_KEYS)}, '') AS gap_to_leader FROM timing""",
)
def fold_as_of(spark, sf_dir):
    deltas = fold.timing_deltas(_events(spark, sf_dir))
    state = fold.timing_as_of(deltas)
    return state.select("session_id", "car", "seq", "position", "in_pit", "gap_to_leader")


@query(
    "c3_fold_as_of_chunked",
    f"""WITH {MSG} SELECT session_id, car, seq, {last_so_far("position", CAR_KEYS)} AS position,
      coalesce({last_so_far("in_pit", CAR_KEYS)}, FALSE) AS in_pit,
      nullif({last_so_far("gap", CAR_KEYS)}, '') AS gap_to_leader FROM timing""",
)
def fold_as_of_chunked(spark, sf_dir):
    """The same fold with short chunks, as it runs on keys too big for one task."""
    state = fold.timing_as_of(fold.timing_deltas(_events(spark, sf_dir)), span=1000)
    return state.select("session_id", "car", "seq", "position", "in_pit", "gap_to_leader")


@query(
    "c4_event_counters",
    f"""WITH {MSG} SELECT session_id, count(*) AS events_applied,
      epoch_us(arg_max(ts, seq)) - epoch_us(arg_min(ts, seq)) AS micros
    FROM msg GROUP BY session_id""",
)
def event_counters(spark, sf_dir):
    counted = fold.event_counters(recordings.with_session_time(_events(spark, sf_dir)))
    micros = F.expr("cast(extract(second from session_time) * 1000000 as bigint)")
    whole = F.expr(
        "(extract(day from session_time) * 86400L + extract(hour from session_time) * 3600L"
        " + extract(minute from session_time) * 60L) * 1000000L"
    )
    return counted.select(
        "session_id", "events_applied", (whole.cast("bigint") + micros).alias("micros")
    )


@query(
    "c5_session_projection",
    f"""WITH {MSG} SELECT session_id, coalesce({last_of("name")}, '') AS session_name,
      coalesce({last_of("type")}, '') AS session_type,
      coalesce({last_of("short_name")}, {last_of("location")}, '') AS circuit
    FROM sess GROUP BY session_id""",
)
def session_projection(spark, sf_dir):
    state = fold.session_state(fold.session_deltas(_events(spark, sf_dir)))
    return state.select("session_id", "session_name", "session_type", "circuit")


@query(
    "c6_lap_count",
    f"""WITH {MSG} SELECT session_id, coalesce({last_of("lap")}, 0) AS lap,
      coalesce({last_of("total_laps")}, 0) AS total_laps FROM sess GROUP BY session_id""",
)
def lap_count(spark, sf_dir):
    state = fold.session_state(fold.session_deltas(_events(spark, sf_dir)))
    return state.select("session_id", "lap", "total_laps")


@query(
    "c7_status_spans",
    f"WITH {FEED_LAPS} SELECT session_id, status, start_seq, end_seq FROM spans",
)
def status_spans(spark, sf_dir):
    session = fold.session_deltas(_events(spark, sf_dir))
    return fold.status_spans(session)


@query("c8_driver_dimension", f"WITH {CARS} SELECT session_id, car, tla, name, team FROM nstate")
def driver_dimension(spark, sf_dir):
    return fold.driver_state(fold.driver_deltas(_events(spark, sf_dir))).drop("first_seen")


@query(
    "c9_weather",
    f"""WITH {MSG} SELECT session_id, {last_of("air")} AS air_temp, {last_of("track")} AS track_temp,
      coalesce({last_of("rain")}, FALSE) AS rainfall FROM sess GROUP BY session_id""",
)
def weather(spark, sf_dir):
    state = fold.session_state(fold.session_deltas(_events(spark, sf_dir)))
    return state.select("session_id", "air_temp", "track_temp", "rainfall")


@query(
    "c10_timing_projection",
    f"""WITH {CARS} SELECT session_id, car, position, laps_completed, gap_to_leader,
      ival AS interval_text, round(last_lap_time, 6) AS last_lap_time, s0 AS sector_0,
      s1 AS sector_1, s2 AS sector_2, in_pit, pit_out, retired FROM tstate""",
)
def timing_projection(spark, sf_dir):
    state = fold.timing_state(fold.timing_deltas(_events(spark, sf_dir)))
    return state.withColumn("last_lap_time", r6("last_lap_time")).drop(
        "pit_count", "best_lap_time", "stopped", "first_seen"
    )


@query(
    "c11_stint_projection",
    f"""WITH {CARS} SELECT session_id, car, stint, compound, is_new, total_laps FROM sall""",
)
def stint_projection(spark, sf_dir):
    state = fold.stint_state(fold.stint_deltas(_events(spark, sf_dir)))
    return fold.stint_rows(state).select("session_id", "car", "stint", "compound", "is_new", "total_laps")


@query(
    "c12_running_order",
    f"""WITH {CARS} SELECT session_id, car, row_number() OVER (PARTITION BY session_id
      ORDER BY position IS NULL, CASE WHEN position = 0 THEN 999 ELSE position END, first_seen) AS place
    FROM cars""",
)
def running_order(spark, sf_dir):
    from lapstream.operators import grid

    placed = grid.with_place(cut_lineage(_cars(spark, sf_dir), "cars"))
    return placed.select("session_id", "car", "place")


@query("c13_by_code", f"WITH {CARS} SELECT session_id, car FROM cars WHERE tla = 'T42'")
def by_code(spark, sf_dir):
    return fold.by_code(_cars(spark, sf_dir), " t42 ").select("session_id", "car")


@query(
    "c14_unknown_topics",
    f"WITH {MSG} SELECT DISTINCT etype AS topic FROM msg",
)
def unknown_topics(spark, sf_dir):
    """The plain event types are unknown to the feed, so all of them are reported."""
    return fold.unknown_topics(standins.feed(spark, sf_dir))


@query(
    "c14_raw_topics",
    f"WITH {MSG} SELECT session_id, etype AS topic, max(seq) AS seq FROM msg GROUP BY 1, 2",
)
def raw_topics(spark, sf_dir):
    rows = standins.feed(spark, sf_dir).withColumn("payload", F.col("k").cast("variant"))
    rows = rows.withColumn("session_id", F.col("session_id").cast("string"))
    return fold.raw_topics(rows).select("session_id", "topic", "seq")


@query("c15_topic_census", f"WITH {MSG} SELECT topic, count(*) AS events FROM msg GROUP BY topic")
def topic_census(spark, sf_dir):
    return fold.topic_census(_events(spark, sf_dir))


@query(
    "c15_census_total",
    f"WITH {MSG} SELECT count(*) AS events, count(DISTINCT topic) AS topics FROM msg",
)
def census_total(spark, sf_dir):
    return fold.census_total(_events(spark, sf_dir))


@query(
    "c16_timing_board",
    f"""WITH {CARS} SELECT session_id, coalesce(position, 0) AS position,
      coalesce(nullif(tla, ''), car) AS code,
      CASE compound WHEN 'SOFT' THEN 'SOF' WHEN 'HARD' THEN 'HAR' ELSE '---' END AS tyre, tyre_age,
      round(last_lap_time, 6) AS last_lap_time, gap_to_leader, ival AS "interval",
      CASE WHEN in_pit THEN 'PIT' WHEN retired THEN 'OUT' ELSE '' END AS flag
    FROM cars WHERE position IS NOT NULL OR tla <> ''""",
)
def timing_board(spark, sf_dir):
    board = fold.timing_board(_cars(spark, sf_dir)).drop("pit_count")
    return board.withColumn("last_lap_time", r6("last_lap_time"))


def _timeline(spark, sf_dir):
    events = _events(spark, sf_dir)
    return laps.car_timeline(
        fold.timing_deltas(events), fold.stint_deltas(events), fold.driver_deltas(events)
    )


@query("d1_completed_laps", f"WITH {MSG} SELECT session_id, car, seq FROM timing WHERE completes")
def completed_laps(spark, sf_dir):
    deltas = fold.timing_deltas(_events(spark, sf_dir)).where("completes_lap")
    return deltas.select("session_id", "car", "seq")


@query("d2_lap_number", f"WITH {FEED_LAPS} SELECT session_id, car, seq, lap FROM num")
def lap_number(spark, sf_dir):
    context = laps.car_context(cut_lineage(_timeline(spark, sf_dir), "timeline"))
    context = context.where("completes_lap")
    lap = F.coalesce("lap_sent", "laps_completed", F.lit(0)) - 1
    return context.select("session_id", "car", "seq", lap.alias("lap")).where("lap >= 1")


@query("d3_drop_repeats", f"WITH {FEED_LAPS} SELECT session_id, car, seq, lap, prev_seq FROM acc")
def drop_repeats(spark, sf_dir):
    done = laps.completions(_timeline(spark, sf_dir))
    return done.select("session_id", "car", "seq", "lap", "prev_seq")


@query(
    "d4_lap_context",
    f"""WITH {FEED_LAPS}, began AS (SELECT session_id, arg_min(ts, seq) AS t0 FROM msg GROUP BY 1)
    SELECT f.session_id, driver, f.seq, lap, round(lap_time, 6) AS lap_time, tla,
      team, compound, tyre_age, stint, position, round(gap_s, 6) AS "interval", gap_to_leader,
      retired, round((epoch_us(m.ts) - epoch_us(t0)) / CAST(1000000 AS DOUBLE), 6) AS seconds
    FROM flaps f JOIN msg m ON m.session_id = f.session_id AND m.seq = f.seq
      JOIN began b ON b.session_id = f.session_id""",
)
def lap_context(spark, sf_dir):
    events = recordings.with_session_time(_events(spark, sf_dir))
    found = laps.extract_laps(
        fold.timing_deltas(events),
        fold.stint_deltas(events),
        fold.driver_deltas(events),
        fold.session_deltas(events),
    )
    seconds = F.extract(F.lit("DAY"), "session_time") * 86400 + F.extract(F.lit("HOUR"), "session_time") * 3600
    seconds += F.extract(F.lit("MINUTE"), "session_time") * 60 + F.extract(F.lit("SECOND"), "session_time")
    return found.withColumn("seconds", r6(seconds.cast("double"))).drop(
        "track_statuses", "entered_pit", "exited_pit", "session_time"
    ).withColumns({"lap_time": r6("lap_time"), "interval": r6("interval")})


@query(
    "d4_lap_context_chunked",
    f"""WITH {FEED_LAPS} SELECT session_id, driver, seq, lap, compound, tyre_age, stint, statuses,
      entered_pit, exited_pit FROM flaps""",
)
def lap_context_chunked(spark, sf_dir):
    """Lap extraction with short chunks, as it runs on sessions too big for one task."""
    events = _events(spark, sf_dir)
    found = laps.extract_laps(
        fold.timing_deltas(events),
        fold.stint_deltas(events),
        fold.driver_deltas(events),
        fold.session_deltas(events),
        span=2500,
    )
    return found.select(
        "session_id", "driver", "seq", "lap", "compound", "tyre_age", "stint",
        joined("track_statuses").alias("statuses"), "entered_pit", "exited_pit",
    )


@query(
    "d5_track_statuses",
    f"WITH {FEED_LAPS} SELECT session_id, driver, seq, statuses FROM flaps",
)
def track_statuses(spark, sf_dir):
    found = feed_laps(spark, sf_dir)
    return found.select("session_id", "driver", "seq", joined("track_statuses").alias("statuses"))


@query(
    "d6_pit_flags",
    f"WITH {FEED_LAPS} SELECT session_id, driver, seq, entered_pit, exited_pit FROM flaps",
)
def pit_flags(spark, sf_dir):
    return feed_laps(spark, sf_dir).select("session_id", "driver", "seq", "entered_pit", "exited_pit")


@query(
    "d7_neutralised_laps",
    f"""WITH {FEED_LAPS} SELECT session_id, driver, seq,
      regexp_matches(statuses, '[456]') AS neutralised FROM flaps""",
)
def neutralised(spark, sf_dir):
    return feed_laps(spark, sf_dir).select(
        "session_id", "driver", "seq", was_neutralised().alias("neutralised")
    )


@query(
    "d8_as_of_lap",
    f"""WITH {MSG}, want AS (SELECT CAST(unnest([16, 24, 32, 40, 48]) AS BIGINT) AS as_of_lap),
      cut AS (SELECT session_id, as_of_lap, min(CASE WHEN lap > as_of_lap THEN seq END) AS cutoff
        FROM sess CROSS JOIN want WHERE lap IS NOT NULL GROUP BY 1, 2
        HAVING max(lap) >= as_of_lap)
    SELECT m.session_id, as_of_lap, count(*) AS events, max(seq) AS last_seq
    FROM msg m JOIN cut USING (session_id) WHERE cutoff IS NULL OR seq <= cutoff GROUP BY 1, 2""",
)
def as_of_lap(spark, sf_dir):
    events = _events(spark, sf_dir)
    cutoffs = laps.lap_cutoffs(fold.session_deltas(events), [16, 24, 32, 40, 48])
    known = laps.as_of_lap(events.select("session_id", "seq"), cutoffs)
    return known.groupBy("session_id", "as_of_lap").agg(
        F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq")
    )


@query(
    "b14_progress",
    f"""WITH {MSG}, s AS (SELECT session_id, coalesce({last_of("lap")}, 0) AS lap,
        coalesce({last_of("total_laps")}, 0) AS total FROM sess GROUP BY session_id)
    SELECT session_id, greatest(0, total - lap) AS remaining,
      coalesce(round(lap / CAST(nullif(total, 0) AS DOUBLE), 4), 0) AS progress FROM s""",
)
def progress(spark, sf_dir):
    state = fold.session_state(fold.session_deltas(_events(spark, sf_dir)))
    lap, total = F.col("lap"), F.col("total_laps")
    return state.select(
        "session_id",
        race.laps_remaining(lap, total).alias("remaining"),
        race.progress(lap, total).alias("progress"),
    )


@query(
    "b18_current_tyre",
    f"""WITH {CARS} SELECT session_id, car, compound, tyre_age FROM cars""",
)
def current_tyre(spark, sf_dir):
    return _cars(spark, sf_dir).select("session_id", "car", "compound", "tyre_age")


@query(
    "b10_track_status",
    f"""WITH {MSG} SELECT seq, status AS code, CASE status WHEN '1' THEN 'ALL_CLEAR'
      WHEN '2' THEN 'YELLOW' WHEN '3' THEN 'GREEN_RESUMED' WHEN '4' THEN 'SAFETY_CAR'
      WHEN '5' THEN 'RED' WHEN '6' THEN 'VSC' WHEN '7' THEN 'VSC_ENDING' ELSE 'UNKNOWN' END AS name
    FROM sess WHERE status IS NOT NULL""",
)
def track_status(spark, sf_dir):
    sent = fold.session_deltas(_events(spark, sf_dir)).where(F.col("status").isNotNull())
    return sent.select(
        "seq", F.col("status").alias("code"), text.track_status_name(F.col("status")).alias("name")
    )
