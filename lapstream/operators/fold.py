"""Race state from feed deltas: what was last written to each field, and when.

Payloads are opened once into rows with one typed column per field. State is then
the last usable value per field, either over everything (an aggregate) or as of
each row (a blocked running scan, see ``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions import text
from lapstream.operators.scan import last_states, running
from lapstream.session import cut_lineage

# Topics that are stored as they come and have no projection.
UNPROJECTED = (
    "Heartbeat",
    "CarData",
    "Position",
    "ExtrapolatedClock",
    "TopThree",
    "RcmSeries",
    "TimingStats",
    "SessionData",
    "SessionStatus",
    "RaceControlMessages",
    "TeamRadio",
    "AudioStreams",
    "ContentStreams",
    "DriverRaceInfo",
    "LapSeries",
    "PitLaneTimeCollection",
    "ChampionshipPrediction",
    "TyreStintSeries",
    "SessionAssets",
    "WeatherDataSeries",
)
PROJECTED = (
    "SessionInfo",
    "LapCount",
    "TrackStatus",
    "DriverList",
    "WeatherData",
    "TimingData",
    "TimingAppData",
)

CAR = ("session_id", "car")
SESSION = ("session_id",)
UNPLACED = 999
#: Stints of a gap that are dealt out together.
GAP_PART = 4096


def _at(source: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(source, path, kind)


def _present(source: str, path: str) -> Column:
    return _at(source, path, "variant").isNotNull()


def _shape(value: Column) -> Column:
    """First character of a value's JSON: ``{`` object, ``[`` list, else scalar."""
    return F.substring(F.to_json(value), 1, 1)


def is_container(payload: Column) -> Column:
    return _shape(payload).isin("{", "[")


def _members(df: DataFrame, value: Column, extra: Sequence[Column | str]) -> DataFrame:
    """One row per member of an object or list: ``key`` (index for lists), ``value``."""
    opened = df.lateralJoin(df.sparkSession.tvf.variant_explode(value))
    return opened.select(
        *extra, F.coalesce("key", F.col("pos").cast("string")).alias("key"), "value"
    )


def _session_time(events: DataFrame) -> Column:
    """Time since the session began, NULL for events that carry none."""
    if "session_time" in events.columns:
        return F.col("session_time")
    return F.lit(None).cast("interval day to second").alias("session_time")


def _lines(events: DataFrame, topic: str) -> DataFrame:
    """One row per car of a ``Lines`` payload: car, line, and whether Lines was a list."""
    wanted = events.where(F.col("topic") == topic).select(
        "session_id", "seq", "ts", _session_time(events), _at("payload", "$.Lines", "variant").alias("lines")
    )
    wanted = wanted.withColumn("from_list", _shape(F.col("lines")) == "[")
    rows = _members(wanted, F.col("lines").outer(), ["session_id", "seq", "ts", "session_time", "from_list"])
    return rows.where(_shape(F.col("value")) == "{").withColumnsRenamed(
        {"key": "car", "value": "line"}
    )


def timing_deltas(events: DataFrame) -> DataFrame:
    """Timing changes, one row per (event, car); NULL where a field was not sent.

    Text fields keep '' for "sent but blank" so that a blank still overwrites.
    """
    rows = _lines(events, "TimingData")
    nested = _shape(_at("line", "$.IntervalToPositionAhead", "variant")) == "{"

    def timed(path: str) -> Column:
        return text.lap_time_seconds(_at("line", path))

    def flag(name: str) -> Column:
        return F.when(_present("line", f"$.{name}"), text.as_bool(_at("line", f"$.{name}")))

    last = _at("line", "$.LastLapTime", "variant")
    return rows.select(
        "session_id",
        "car",
        "seq",
        "ts",
        "session_time",
        text.as_int(_at("line", "$.Position")).alias("position"),
        text.as_int(_at("line", "$.NumberOfLaps")).alias("laps_completed"),
        text.as_int(_at("line", "$.NumberOfPitStops")).alias("pit_count"),
        _at("line", "$.GapToLeader").alias("gap_to_leader"),
        F.when(nested, _at("line", "$.IntervalToPositionAhead.Value"))
        .otherwise(_at("line", "$.IntervalToPositionAhead"))
        .alias("interval_text"),
        timed("$.LastLapTime.Value").alias("last_lap_time"),
        timed("$.BestLapTime.Value").alias("best_lap_time"),
        *[_sector(i).alias(f"sector_{i}") for i in range(3)],
        flag("InPit").alias("in_pit"),
        flag("PitOut").alias("pit_out"),
        flag("Retired").alias("retired"),
        flag("Stopped").alias("stopped"),
        (last.isNotNull() & ~F.col("from_list")).alias("completes_lap"),
        F.coalesce(
            timed("$.LastLapTime.Value"),
            F.when(_shape(last) != "{", text.lap_time_seconds(_at("line", "$.LastLapTime"))),
        ).alias("lap_time"),
    )


def _sector(i: int) -> Column:
    """Sector time, from either shape of ``Sectors``: keyed by index or a list."""
    keyed, listed = (
        text.lap_time_seconds(_at("line", p))
        for p in (f"$.Sectors['{i}'].Value", f"$.Sectors[{i}].Value")
    )
    return F.coalesce(keyed, listed)


TIMING_FIELDS = (
    "position", "laps_completed", "pit_count", "gap_to_leader", "interval_text",
    "last_lap_time", "best_lap_time", "sector_0", "sector_1", "sector_2",
    "in_pit", "pit_out", "retired", "stopped",
)
FLAG_FIELDS = ("in_pit", "pit_out", "retired", "stopped")
BLANKABLE = ("gap_to_leader", "interval_text")


def stint_deltas(events: DataFrame) -> DataFrame:
    """Stint changes, one row per (event, car, stint index); other keys are passed over."""
    lines = _lines(events, "TimingAppData").withColumn(
        "stints", _at("line", "$.Stints", "variant")
    )
    rows = _members(lines, F.col("stints").outer(), ["session_id", "car", "seq", "ts"])
    rows = rows.where((_shape(F.col("value")) == "{") & F.col("key").rlike(r"^\d+$"))
    compound = text.parse_compound(_at("value", "$.Compound"))
    return rows.select(
        "session_id",
        "car",
        "seq",
        "ts",
        text.as_int(F.col("key")).alias("stint"),
        F.when(compound != "UNKNOWN", compound).alias("compound"),
        F.when(_present("value", "$.New"), text.as_bool(_at("value", "$.New"))).alias("is_new"),
        text.as_int(_at("value", "$.StartLaps")).alias("start_laps"),
        text.as_int(_at("value", "$.TotalLaps")).alias("total_laps"),
    )


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def driver_deltas(events: DataFrame) -> DataFrame:
    """Driver names, one row per (event, car); blanks count as not sent.

    ``full_sent`` and ``broadcast_sent`` keep a blank, which takes a name back.
    """
    listed = events.where((F.col("topic") == "DriverList") & (_shape(F.col("payload")) == "{"))
    rows = _members(listed, F.col("payload").outer(), ["session_id", "seq", "ts"])
    rows = rows.where(F.col("key").rlike(r"^\d+$") & (_shape(F.col("value")) == "{"))
    return rows.select(
        "session_id",
        F.col("key").alias("car"),
        "seq",
        "ts",
        _filled(_at("value", "$.Tla")).alias("tla"),
        _filled(_at("value", "$.FullName")).alias("full_name"),
        _filled(_at("value", "$.BroadcastName")).alias("broadcast_name"),
        _filled(_at("value", "$.TeamName")).alias("team"),
        _at("value", "$.FullName").alias("full_sent"),
        _at("value", "$.BroadcastName").alias("broadcast_sent"),
    )


def session_deltas(events: DataFrame) -> DataFrame:
    """Session-wide fields, one row per event of the topics that carry them."""
    topics = ("SessionInfo", "LapCount", "TrackStatus", "WeatherData")
    rows = events.where(F.col("topic").isin(*topics) & (_shape(F.col("payload")) == "{"))

    def of(topic: str, value: Column) -> Column:
        return F.when(F.col("topic") == topic, value)

    def weather(name: str) -> Column:
        reading = text.as_float(_at("payload", f"$.{name}"))
        return of("WeatherData", F.nullif(reading, F.lit(0.0)))

    rain = F.when(_present("payload", "$.Rainfall"), text.as_bool(_at("payload", "$.Rainfall")))
    status = _at("payload", "$.Status")
    return rows.select(
        "session_id",
        "seq",
        "ts",
        "topic",
        of("SessionInfo", _at("payload", "$.Name")).alias("session_name"),
        of("SessionInfo", _at("payload", "$.Type")).alias("session_type"),
        of("SessionInfo", _at("payload", "$.Meeting.Circuit.ShortName")).alias("circuit_name"),
        of("SessionInfo", _at("payload", "$.Meeting.Location")).alias("location"),
        of("LapCount", text.as_int(_at("payload", "$.CurrentLap"))).alias("lap"),
        of("LapCount", text.as_int(_at("payload", "$.TotalLaps"))).alias("total_laps"),
        of("TrackStatus", F.when(status.isNotNull(), text.track_status_code(status))).alias("status"),
        weather("AirTemp").alias("air_temp"),
        weather("TrackTemp").alias("track_temp"),
        weather("Humidity").alias("humidity"),
        weather("Pressure").alias("pressure"),
        weather("WindSpeed").alias("wind_speed"),
        weather("WindDirection").alias("wind_direction"),
        of("WeatherData", rain).alias("rainfall"),
    )


SESSION_FIELDS = (
    "session_name", "session_type", "circuit_name", "location", "lap", "total_laps", "status",
    "air_temp", "track_temp", "humidity", "pressure", "wind_speed", "wind_direction", "rainfall",
)


def _timing_view(df: DataFrame) -> DataFrame:
    """Blank text to NULL, unset flags and counters to their start values."""
    fixed = {c: _filled(F.col(c)) for c in BLANKABLE}
    fixed |= {c: F.coalesce(c, F.lit(False)) for c in FLAG_FIELDS}
    fixed |= {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("laps_completed", "pit_count")}
    return df.withColumns(fixed)


def fold_as_of(
    deltas: DataFrame, fields: Sequence[str], keys: Sequence[str] = CAR, **scan: int
) -> DataFrame:
    """State after every row: last non-NULL value of each field so far."""
    kept = cut_lineage(deltas.select(*keys, "seq", *fields), "deltas")
    return running(kept, keys, "seq", lasts={f: F.col(f) for f in fields}, **scan)


def timing_as_of(deltas: DataFrame, **scan: int) -> DataFrame:
    return _timing_view(fold_as_of(deltas, TIMING_FIELDS, **scan))


def timing_state(deltas: DataFrame) -> DataFrame:
    """Final timing state, one row per car."""
    latest = last_states(
        deltas, CAR, "seq", {f: F.col(f) for f in TIMING_FIELDS}, first="first_seen"
    )
    return _timing_view(latest)


def driver_state(deltas: DataFrame) -> DataFrame:
    """Driver dimension. A full name that stands wins over a broadcast name that stands.

    Where both were blanked, the one that was blanked last was shown until then and stays.
    """
    fields = ("tla", "full_name", "broadcast_name", "team", "full_sent", "broadcast_sent")
    values = {c: F.col(c) for c in fields}
    values |= {f"{c}_at": F.when(F.col(c) == "", F.col("seq")) for c in ("full_sent", "broadcast_sent")}
    latest = last_states(deltas, CAR, "seq", values, first="first_seen")
    full_last = F.coalesce("full_sent_at", F.lit(-1)) >= F.coalesce("broadcast_sent_at", F.lit(-1))
    name = F.coalesce(
        _filled(F.col("full_sent")),
        _filled(F.col("broadcast_sent")),
        F.when(full_last, F.coalesce("full_name", "broadcast_name")),
        F.col("broadcast_name"),
        F.col("full_name"),
    )
    return latest.select(*CAR, "tla", name.alias("name"), "team", "first_seen")


def stint_state(deltas: DataFrame) -> DataFrame:
    """``stints`` array per car: the stints that were sent, in index order, with their index.

    State is folded per (car, stint) first, so what is gathered per car is one entry per
    stint run. Indexes come from the feed and may be any number; those between, never sent,
    are unknown sets of no laps and take no room (:func:`stint_rows` shows them).
    """
    fields = ("compound", "is_new", "start_laps", "total_laps")
    each = last_states(
        deltas.where(F.col("stint").isNotNull()), [*CAR, "stint"], "seq", {f: F.col(f) for f in fields}, first="first_seen"
    )
    unset = _unset_stint()
    entry = F.struct("stint", *[F.coalesce(f, unset[f]).alias(f) for f in fields])
    return each.groupBy(*CAR).agg(
        F.array_sort(F.collect_list(entry)).alias("stints"), F.min("first_seen").alias("first_seen")
    )


def _unset_stint() -> dict[str, Column]:
    unset = {"compound": F.lit("UNKNOWN"), "is_new": F.lit(True)}
    return unset | {f: F.lit(0).cast("bigint") for f in ("start_laps", "total_laps")}


def stint_rows(state: DataFrame) -> DataFrame:
    """A row per stint of a car from its first to its last, gaps as unknown sets.

    A gap is a run until here; it is dealt out in parts, so its length never sizes an array.
    """
    sent = state.select(*CAR, F.posexplode("stints").alias("at", "s"), "stints").select(
        *CAR, "s", F.coalesce(F.get("stints", F.col("at") - 1)["stint"] + 1, F.lit(0).cast("bigint")).alias("low")
    )
    high = F.col("s.stint") - 1
    parts = sent.where(F.col("low") <= high).select(
        *CAR, "low", high.alias("high"), F.explode(F.sequence(F.expr(f"low div {GAP_PART}"), F.expr(f"(s.stint - 1) div {GAP_PART}"))).alias("part")
    )
    start = F.greatest("low", F.col("part") * GAP_PART)
    end = F.least("high", F.col("part") * GAP_PART + GAP_PART - 1)
    unset = [value.alias(name) for name, value in _unset_stint().items()]
    gaps = parts.select(*CAR, F.explode(F.sequence(start, end)).alias("stint"), *unset)
    return sent.select(*CAR, "s.*").unionByName(gaps)


def session_state(deltas: DataFrame) -> DataFrame:
    """Final session row: names, circuit, lap count, status, weather."""
    latest = last_states(deltas, SESSION, "seq", {f: F.col(f) for f in SESSION_FIELDS})
    return _session_view(latest)


def _session_view(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.withColumns(
        {
            "session_name": F.coalesce("session_name", F.lit("")),
            "session_type": F.coalesce("session_type", F.lit("")),
            "circuit": F.coalesce(
                _filled(F.col("circuit_name")), _filled(F.col("location")), F.lit("")
            ),
            "lap": F.coalesce("lap", zero),
            "total_laps": F.coalesce("total_laps", zero),
            "status": F.coalesce("status", F.lit("0")),
            "rainfall": F.coalesce("rainfall", F.lit(False)),
        }
    ).drop("circuit_name", "location")


def session_as_of(deltas: DataFrame, **scan: int) -> DataFrame:
    return _session_view(fold_as_of(deltas, SESSION_FIELDS, SESSION, **scan))


def event_counters(events: DataFrame) -> DataFrame:
    """Events per session, whatever their payload, and the latest session time."""
    stamped = F.when(F.col("session_time").isNotNull(), F.col("seq"))
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events_applied"),
        F.max_by("session_time", stamped).alias("session_time"),
    )


def status_spans(deltas: DataFrame, **scan: int) -> DataFrame:
    """Track status timeline: code, first and (exclusive) last seq; open spans end NULL."""
    sent = deltas.where(F.col("status").isNotNull()).select("session_id", "seq", "status")
    sent = cut_lineage(sent, "statuses")
    seen = running(sent, SESSION, "seq", lags={"before": F.col("status")}, **scan)
    changed = seen.where(F.col("status") != F.coalesce("before", F.lit("0"))).drop("before")
    changed = cut_lineage(changed, "changes")
    # The next change closes a span: look backwards along the reversed order.
    turned = changed.withColumn("_back", -F.col("seq"))
    closed = running(turned, SESSION, "_back", lags={"end_seq": F.col("seq")}, **scan)
    return closed.select("session_id", "status", F.col("seq").alias("start_seq"), "end_seq")


def car_state(timing: DataFrame, stints: DataFrame, drivers: DataFrame) -> DataFrame:
    """One row per car: timing, tyres and names side by side.

    ``first_seen``, the first event to mention the car, breaks ties in the order.
    """
    parts = [
        part.withColumnRenamed("first_seen", f"_seen_{i}")
        for i, part in enumerate((timing, stints, drivers))
    ]
    both = parts[0].join(parts[1], list(CAR), "full").join(parts[2], list(CAR), "full")
    both = both.withColumn("first_seen", F.least("_seen_0", "_seen_1", "_seen_2"))
    both = both.drop("_seen_0", "_seen_1", "_seen_2")
    zero = F.lit(0).cast("bigint")
    return both.withColumns(
        {
            "tla": F.coalesce("tla", F.lit("")),
            "compound": text.current_compound(F.col("stints")),
            "tyre_age": text.tyre_age(F.col("stints")),
            "pit_count": F.coalesce("pit_count", zero),
            "laps_completed": F.coalesce("laps_completed", zero),
            **{f: F.coalesce(f, F.lit(False)) for f in FLAG_FIELDS},
        }
    )


def order_columns() -> list[Column]:
    """Classified cars by position, unclassified last; position 0 counts as far back.

    Level cars keep the order in which they were first seen, then that of their numbers.
   """
    place = F.when(F.col("position") == 0, UNPLACED).otherwise(F.col("position"))
    return [
        F.col("position").isNull(),
        F.coalesce(place, F.lit(UNPLACED)),
        F.col("first_seen"),
        F.col("car"),
    ]


def running_order(cars: DataFrame) -> DataFrame:
    """Cars in classified order within each session."""
    return cars.orderBy("session_id", *order_columns())


def by_code(cars: DataFrame, code: str) -> DataFrame:
    return cars.where(F.col("tla") == F.upper(F.trim(F.lit(code))))


def unknown_topics(events: DataFrame) -> DataFrame:
    """Topics nothing here knows. The known list is fixed, so a filter is the anti join."""
    return (
        events.where(~F.col("topic").isin(*UNPROJECTED, *PROJECTED)).select("topic").distinct()
    )


def raw_topics(events: DataFrame) -> DataFrame:
    """Latest payload of topics without a projection."""
    rest = events.where(~F.col("topic").isin(*PROJECTED))
    return rest.groupBy("session_id", "topic").agg(
        F.max_by(F.to_json("payload"), "seq").alias("payload"), F.max("seq").alias("seq")
    )


def topic_census(events: DataFrame) -> DataFrame:
    """Events per topic, biggest first."""
    return events.groupBy("topic").agg(F.count(F.lit(1)).alias("events")).orderBy(
        F.desc("events"), "topic"
    )


def census_total(events: DataFrame) -> DataFrame:
    per_topic = events.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return per_topic.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("topics"))


def timing_board(cars: DataFrame, limit: int | None = None) -> DataFrame:
    """The timing screen: the whole field by default, in running order."""
    shown = running_order(cars.where(F.col("position").isNotNull() | (F.col("tla") != "")))
    flag = F.when(F.col("in_pit"), "PIT").when(F.col("retired") | F.col("stopped"), "OUT")
    board = shown.select(
        "session_id",
        F.coalesce("position", F.lit(0).cast("bigint")).alias("position"),
        F.coalesce(_filled(F.col("tla")), F.col("car")).alias("code"),
        text.compound_short(F.col("compound")).alias("tyre"),
        "tyre_age",
        "last_lap_time",
        "gap_to_leader",
        F.col("interval_text").alias("interval"),
        "pit_count",
        F.coalesce(flag, F.lit("")).alias("flag"),
    )
    return board.limit(limit) if limit else board
