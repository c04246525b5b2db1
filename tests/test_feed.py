"""A short recording of three cars, from text lines to laps."""

from __future__ import annotations

import base64
import json
import zlib

import pytest
from pyspark.sql import functions as F

from lapstream.operators import board, fold, grid, laps
from lapstream.sources import frames, recordings


def packed(payload):
    packer = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    return base64.b64encode(packer.compress(json.dumps(payload).encode()) + packer.flush()).decode()


def at(minute):
    return f"2031-03-09T05:{20 + minute}:30.7654321Z"


def timing(minute, **lines):
    return ["TimingData", {"Lines": {car.removeprefix("car"): line for car, line in lines.items()}}, at(minute)]


def tyres(minute, **cars):
    lines = {car.removeprefix("car"): {"Stints": stints} for car, stints in cars.items()}
    return ["TimingAppData", {"Lines": lines}, at(minute)]


# Joined in the fifth lap: 16 leads 5 and 77. 5 and 77 finish laps in one event, 16 on its
# own. 77 then pits under a virtual safety car for its second set.
LINES = [
    ["WeatherData", {"AirTemp": "11.9", "TrackTemp": "19.25", "Rainfall": "1"}, at(0)],
    ["LapCount", {"TotalLaps": 52, "CurrentLap": 5}, at(0)],
    ["SessionInfo", json.dumps({"Type": "Race", "Name": "Night heat", "Meeting": {"Location": "Dunes"}}), ""],
    ["DriverList", {"_kf": True, "77": {"Tla": "MOR", "BroadcastName": "M Orr"},
                    "16": {"Tla": "KIT", "FullName": "Kit Hale", "TeamName": "North"},
                    "5": {"Tla": "LUX", "FullName": "Lux Reyes", "TeamName": "West"}}, at(0)],
    tyres(0, car5=[{"Compound": "HARD", "New": "false", "TotalLaps": 9}],
          car16={"0": {"Compound": "SOFT", "TotalLaps": 4}}, car77={"0": {"Compound": "SOFT", "TotalLaps": 4}}),
    timing(1, car77={"Position": "3", "GapToLeader": "+6.250"}, car16={"Position": "1", "GapToLeader": "LAP 5"},
           car5={"Position": "2", "GapToLeader": "+2.125"}),
    ["TrackStatus", {"Status": "1"}, at(1)],
    timing(2, car16={"NumberOfLaps": 5, "LastLapTime": {"Value": "1:31.250"}, "Sectors": [{"Value": "30.5"}]}),
    timing(2, car5={"NumberOfLaps": 5, "LastLapTime": {"Value": "1:31.875"}, "IntervalToPositionAhead": "+2.750"},
           car77={"NumberOfLaps": 5, "LastLapTime": {"Value": "1:33.000"}, "GapToLeader": "+8.000"}),
    ["LapCount", {"CurrentLap": 6}, at(2)],
    ["TrackStatus", {"Status": "6"}, at(3)],
    timing(3, car77={"InPit": True, "NumberOfPitStops": 1}, car5={"GapToLeader": "+2.750"}),
    tyres(3, car77={"1": {"Compound": "INTERMEDIATE", "New": "true", "TotalLaps": 0}}, car16={"0": {"TotalLaps": 5}}),
    ["Position.z", packed({"Position": [{"x": 4}]}), at(4)],
    timing(4, car77={"InPit": False, "PitOut": True, "NumberOfLaps": 6, "LastLapTime": {"Value": "1:58.500"}}),
    ["SessionStatus", {"Status": "Started"}, at(5)],
]


def write(tmp_path, rows, name="heat.txt"):
    text = "\n".join(r if isinstance(r, str) else repr(r) for r in rows)
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


@pytest.fixture
def events(spark, tmp_path):
    return recordings.read_recording(spark, write(tmp_path, LINES)).cache()


def state_of(events):
    return fold.car_state(
        fold.timing_state(fold.timing_deltas(events)),
        fold.stint_state(fold.stint_deltas(events)),
        fold.driver_state(fold.driver_deltas(events)),
    )


def laps_of(events, **span):
    return laps.extract_laps(
        fold.timing_deltas(events),
        fold.stint_deltas(events),
        fold.driver_deltas(events),
        fold.session_deltas(events),
        **span,
    )


def test_every_line_becomes_an_event(events):
    rows = events.orderBy("seq").collect()
    assert [r["topic"] for r in rows] == [x[0].removesuffix(".z") for x in LINES]
    assert [r["is_snapshot"] for r in rows] == [not x[2] for x in LINES]
    assert rows[2]["session_time"] is None and rows[0]["session_time"].total_seconds() == 0
    assert rows[-1]["session_time"].total_seconds() == 300
    assert {r["session_id"] for r in rows} == {"heat"}
    assert rows[0]["ts"].microsecond == 765432


def test_files_of_one_name_are_sessions_apart(spark, tmp_path):
    for year in ("2030", "2031"):
        (tmp_path / year).mkdir()
        write(tmp_path / year, [["Heartbeat", {"year": year}, at(0)], ["Heartbeat", {}, at(1)]], "race.txt")
    rows = recordings.read_recording(spark, f"{tmp_path}/*/*.txt").collect()
    assert {r["session_id"] for r in rows} == {"2030/race", "2031/race"}
    assert len({(r["session_id"], r["seq"]) for r in rows}) == 4


def test_lines_are_read_once(spark, tmp_path):
    path = write(tmp_path, LINES)
    decoded = recordings.to_events(recordings.decode_lines(recordings.scan_recording(spark, path)))
    plan = decoded.where("topic = 'TimingData'")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ArrowEvalPython [_read_lines"), plan.count("ArrowEvalPython [_inflate")) == (1, 1)
    events = recordings.read_recording(spark, path).where("topic = 'TimingData'")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "PartitionFilters: [isnotnull(topic" in plan


@pytest.mark.parametrize("line", [
    '["T", {"a": [1, 2.5, null, true], "b": "x"}, "2031-01-01T00:00:00Z"]',
    '["T", "plain", ""]',
    '["T", {"a": "back\\\\slash"}]',
    "['T', {'a': None, 'b': True, 'c': 'é'}, '2031-01-01T00:00:00Z']",
    '["T", 5, null]',
    '[7, {"a": 1}, "x"]',
])
def test_json_and_literal_lines_read_alike(spark, line):
    rows = spark.createDataFrame([("s", 1, line)], "session_id string, seq long, line string")
    got = recordings.decode_lines(rows).first()
    topic, payload, is_text, stamp = recordings.read_line(line)
    assert (got["topic"], got["is_text"]) == (topic, is_text)
    assert got["ts_raw"] == stamp or (got["ts_raw"] is None and stamp == "None")
    assert got["payload"] == payload if is_text else json.loads(got["payload"]) == json.loads(payload)


def test_order_survives_splits(spark, tmp_path):
    rows = [["Heartbeat", {"n": i}, at(i % 10)] for i in range(3000)]
    path = write(tmp_path, rows, "long.txt")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        scan = recordings.scan_recording(spark, path)
        assert scan.rdd.getNumPartitions() > 4
        lines = [r["line"] for r in scan.orderBy("seq").collect()]
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert lines == [repr(r) for r in rows]


def test_unreadable_lines_are_set_aside(spark, tmp_path):
    rows = ["not a [list", "['only one']", "   ", '["Json", {"ok": true}, "2026-01-01T00:00:00Z"]', "{'a': 1}"]
    decoded = recordings.decode_lines(recordings.scan_recording(spark, write(tmp_path, rows)))
    assert recordings.quarantine(decoded).count() == 3
    assert [r["topic"] for r in recordings.readable(decoded).collect()] == ["Json"]


def test_damaged_packed_topic_is_dropped(spark, tmp_path):
    path = write(tmp_path, [["CarData.z", "!!", at(1)], ["Note", "plain text", at(1)]])
    rows = recordings.read_recording(spark, path).collect()
    assert [r["topic"] for r in rows] == ["Note"]


def test_folded_state(events):
    cars = {r["car"]: r for r in state_of(events).collect()}
    five, sixteen, last = cars["5"], cars["16"], cars["77"]
    assert (sixteen["laps_completed"], sixteen["last_lap_time"], sixteen["sector_0"]) == (5, 91.25, 30.5)
    assert (sixteen["compound"], sixteen["tyre_age"], sixteen["gap_to_leader"]) == ("SOFT", 5, "LAP 5")
    assert (five["compound"], five["tyre_age"], five["interval_text"]) == ("HARD", 9, "+2.750")
    assert not five["stints"][0]["is_new"] and five["gap_to_leader"] == "+2.750"
    assert (last["pit_count"], last["in_pit"], last["pit_out"], last["laps_completed"]) == (1, False, True, 6)
    assert [s["compound"] for s in last["stints"]] == ["SOFT", "INTERMEDIATE"] and last["tyre_age"] == 0
    assert [cars[c]["name"] for c in ("5", "16", "77")] == ["Lux Reyes", "Kit Hale", "M Orr"]
    assert last["team"] is None and five["team"] == "West"
    session = fold.session_state(fold.session_deltas(events)).first()
    assert (session["circuit"], session["lap"], session["total_laps"]) == ("Dunes", 6, 52)
    assert (session["status"], session["air_temp"], session["rainfall"]) == ("6", 11.9, True)
    order = [r["tla"] for r in fold.running_order(state_of(events)).collect()]
    assert order == ["KIT", "LUX", "MOR"]


@pytest.mark.parametrize("span", [{}, {"span": 3}])
def test_laps(events, span):
    found = {(r["driver"], r["lap"]): r for r in laps_of(events, **span).collect()}
    times = {k: r["lap_time"] for k, r in found.items()}
    assert times == {("16", 4): 91.25, ("5", 4): 91.875, ("77", 4): 93.0, ("77", 5): 118.5}
    assert found["5", 4]["interval"] == 2.75 and found["16", 4]["interval"] is None
    assert found["16", 4]["track_statuses"] == ["1"] and found["77", 5]["track_statuses"] == ["1", "6"]
    stop = found["77", 5]
    assert (stop["entered_pit"], stop["exited_pit"], stop["stint"], stop["compound"]) == (True, True, 1, "INTERMEDIATE")
    assert {k: r["session_time"].total_seconds() for k, r in found.items()} == {
        ("16", 4): 120, ("5", 4): 120, ("77", 4): 120, ("77", 5): 240,
    }


def test_level_cars_have_one_order(spark):
    cars = {str(n): {"Retired": False} for n in (30, 9, 14, 2)}
    rows = state_of(make(spark, [("TimingData", {"Lines": cars})]))
    placed = {r["car"]: r["place"] for r in grid.with_place(rows).collect()}
    assert placed == {"14": 1, "2": 2, "30": 3, "9": 4}


def test_a_blanked_name_falls_back(spark):
    def name(*sent):
        rows = [("DriverList", {"8": entry}) for entry in sent]
        return fold.driver_state(fold.driver_deltas(make(spark, rows))).first()["name"]

    both = {"FullName": "Full", "BroadcastName": "Short"}
    assert name(both) == "Full"
    assert name(both, {"FullName": ""}) == "Short"
    assert name(both, {"FullName": ""}, {"BroadcastName": ""}) == "Short"
    assert name(both, {"BroadcastName": ""}, {"FullName": ""}) == "Full"
    assert name(both, {"FullName": ""}, {"FullName": "New"}) == "New"


def test_stint_keys_that_are_no_numbers_are_passed_over(spark):
    rows = [("TimingAppData", {"Lines": {"1": {"Stints": {"x": {"Compound": "SOFT"}, "0": {"Compound": "HARD"}}}}})]
    found = fold.stint_state(fold.stint_deltas(make(spark, rows))).first()["stints"]
    assert [s["compound"] for s in found] == ["HARD"]


def test_pace_ladder_keeps_unknown_pace(spark):
    rows = [("s", "a", 91.2), ("s", "b", None), ("s", "c", 90.4)]
    found = grid.pace_ladder(spark.createDataFrame(rows, "session_id string, driver string, pace double")).collect()
    assert {r["driver"]: r["place"] for r in found} == {"c": 1, "a": 2, "b": 3}


def test_junk_timing_leaves_no_cars(spark):
    junk = ['"text"', "5", "null", "[]", '{"Lines": "text"}', '{"Lines": {"1": "x"}}']
    rows = [("s", i, "TimingData", j) for i, j in enumerate(junk)]
    df = spark.createDataFrame(rows, "session_id string, seq long, topic string, j string")
    events = df.select("session_id", "seq", "topic", F.parse_json("j").alias("payload"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    assert fold.timing_deltas(events).count() == 0


def make(spark, rows):
    df = spark.createDataFrame(
        [("s", i, t, json.dumps(p)) for i, (t, p) in enumerate(rows)],
        "session_id string, seq long, topic string, j string",
    )
    return df.select(
        "session_id", "seq", "topic", F.parse_json("j").alias("payload"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )


def done(car, n, time="1:20.0", **more):
    return "TimingData", {"Lines": {car: {"NumberOfLaps": n, "LastLapTime": {"Value": time}, **more}}}


def test_status_and_pit_flags_carry_over(spark):
    rows = [
        ("TrackStatus", {"Status": "1"}),
        done("7", 2),
        ("TrackStatus", {"Status": "4"}),
        ("TimingData", {"Lines": {"7": {"InPit": True}}}),
        ("TrackStatus", {"Status": "1"}),
        done("7", 3),
        done("7", 3, "1:21.0"),
        ("TimingData", {"Lines": {"7": {"InPit": False}}}),
        done("7", 4),
        done("7", 5),
        ("TimingData", {"Lines": [{"LastLapTime": {"Value": "1:30.0"}}]}),
        done("8", 1),
    ]
    found = {r["lap"]: r for r in laps_of(make(spark, rows)).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    assert found[1]["track_statuses"] == ["1"]
    assert found[2]["track_statuses"] == ["1", "4"] and found[2]["entered_pit"]
    assert found[2]["lap_time"] == 80.0
    # The car was still in the pit when lap 2 was counted.
    assert found[3]["entered_pit"] and found[3]["track_statuses"] == ["1"]
    assert not found[4]["entered_pit"]


def test_as_of_lap_keeps_the_crossing_event(spark):
    rows = [("LapCount", {"CurrentLap": n}) for n in (1, 2, 3, 4)]
    events = make(spark, rows)
    cut = laps.lap_cutoffs(fold.session_deltas(events), [2, 9])
    known = laps.as_of_lap(events.select("session_id", "seq"), cut).collect()
    assert sorted((r["as_of_lap"], r["seq"]) for r in known) == [(2, 0), (2, 1), (2, 2)]


def test_weather_zero_does_not_overwrite(spark):
    rows = [("WeatherData", {"AirTemp": "21.5", "Rainfall": "1"}), ("WeatherData", {"AirTemp": "0.0"})]
    session = fold.session_state(fold.session_deltas(make(spark, rows))).first()
    assert session["air_temp"] == 21.5 and session["rainfall"]


def test_unknown_compound_never_overwrites_and_gaps_are_padded(spark):
    rows = [
        ("TimingAppData", {"Lines": {"1": {"Stints": [{"Compound": "SOFT", "TotalLaps": 3}]}}}),
        ("TimingAppData", {"Lines": {"1": {"Stints": {"0": {"Compound": "UNKNOWN"}, "2": {"Compound": "wet"}}}}}),
    ]
    state = fold.stint_state(fold.stint_deltas(make(spark, rows)))
    found = fold.stint_rows(state).orderBy("stint").collect()
    assert [s["compound"] for s in found] == ["SOFT", "UNKNOWN", "WET"]
    assert [s["total_laps"] for s in found] == [3, 0, 0] and found[1]["is_new"]
    assert [(s["stint"], s["compound"]) for s in state.first()["stints"]] == [(0, "SOFT"), (2, "WET")]


def test_a_huge_stint_key_takes_no_room(spark):
    def stint(key, compound):
        return "TimingAppData", {"Lines": {"1": {"Stints": {key: {"Compound": compound, "TotalLaps": 4}}}}}

    events = make(spark, [stint("2", "SOFT"), stint("99999999", "HARD"), stint("9" * 30, "WET"), done("1", 3)])
    state = fold.car_state(
        fold.timing_state(fold.timing_deltas(events)), fold.stint_state(fold.stint_deltas(events)),
        fold.driver_state(fold.driver_deltas(events)),
    )
    car = state.first()
    assert [s["stint"] for s in car["stints"]] == [2, 99999999]
    assert car["compound"] == "HARD" and car["tyre_age"] == 4
    shown = fold.stint_rows(state.withColumn("stints", F.transform("stints", lambda s: s.withField("stint", F.least(s["stint"], F.lit(9000))))))
    assert shown.count() == 9001 and shown.where("compound <> 'UNKNOWN'").count() == 2


def test_frames(spark):
    raw = "\x1e".join([
        json.dumps({"type": 3, "result": {"LapCount": {"CurrentLap": 3}, "CarData.z": packed({"a": 1}), "Bad.z": "?"}}),
        json.dumps({"type": 6}),
        "{broken",
        json.dumps({"type": 1, "target": "feed", "arguments": ["TrackStatus", {"Status": "4"}, "2026-01-01T00:00:01Z"]}),
        json.dumps({"type": 1, "target": "feed", "arguments": ["TooShort"]}),
        json.dumps({"type": 1, "target": "other", "arguments": ["X", {}, ""]}),
        json.dumps({"type": 7}),
        "",
    ])
    df = spark.createDataFrame([("s", 1, raw, "2026-01-01 00:00:03")], "session_id string, frame long, raw string, a string")
    df = df.withColumn("arrival", F.col("a").cast("timestamp")).drop("a")
    rows = frames.message_lag(frames.decode_frames(df)).orderBy("seq").collect()
    assert [r["topic"] for r in rows] == ["LapCount", "CarData", "TrackStatus"]
    assert [r["is_snapshot"] for r in rows] == [True, True, False]
    assert rows[-1]["lag"] == 2.0


def test_a_frame_with_many_topics_keeps_its_order(spark):
    names = [f"T{i * 37 % 300}" for i in range(300)]
    raw = "\x1e".join([
        json.dumps({"type": 3, "result": {n: {"i": i} for i, n in enumerate(names)}}),
        json.dumps({"type": 1, "target": "feed", "arguments": ["Last", {}, "2031-01-01T00:00:01Z"]}),
    ])
    df = spark.createDataFrame([("s", 7, raw)], "session_id string, frame long, raw string")
    rows = frames.decode_frames(df.withColumn("arrival", F.current_timestamp())).orderBy("seq").collect()
    assert [r["topic"] for r in rows] == [*names, "Last"]
    assert len({r["seq"] for r in rows}) == 301
    assert {r["f"] for r in frames.decode_frames(df.withColumn("arrival", F.current_timestamp())).select(
        frames.frame_of(F.col("seq")).alias("f")).collect()} == {7}


def test_board_hides_lap_markers(events):
    cars = state_of(events).withColumn("gap_to_leader", F.lit("LAP 17"))
    trends = board.recent_laps(laps_of(events))
    grids = board.grid_positions(fold.timing_deltas(events))
    rows = board.board_rows(cars, trends, grids).collect()
    assert [r["code"] for r in rows] == ["KIT", "LUX", "MOR"]
    assert {r["gap"] for r in rows} == {None} and rows[0]["gained"] == 0
    assert [s["code"] for s in rows[1]["stint_bar"]] == ["HAR"]


GAPS = ["LAP 17", "+2.5", "+1.0", "1L", "2L", None, "+300.0", "", "+10.0"]


@pytest.mark.parametrize("chunk", [1, 2, 4, 100])
def test_ordered_gaps(spark, chunk):
    rows = [("s", str(i), i + 1, i, g) for i, g in enumerate(GAPS)]
    cars = spark.createDataFrame(
        rows, "session_id string, car string, position long, first_seen long, gap_to_leader string"
    )
    found = grid.ordered_gaps(grid.with_place(cars), chunk=chunk).orderBy("place").collect()
    want, last = [], 0.0
    for i, gap in enumerate(GAPS):
        text = gap or ""
        if i == 0:
            last = 0.0
        elif text in ("1L", "2L"):
            last += 40.0 * int(text[0])
        elif text.startswith("+") and float(text) >= last:
            last = float(text)
        else:
            last += 1.5
        want.append(last)
    assert [r["elapsed"] for r in found] == pytest.approx(want)


def test_session_row(events):
    session = fold.session_state(fold.session_deltas(events))
    row = board.session_rows(session, fold.timing_state(fold.timing_deltas(events))).first()
    assert (row["circuit"], row["lap"], row["progress"], row["laps_remaining"]) == ("Dunes", 6, 0.1154, 46)
    assert (row["neutralised"], row["air_temp"], row["session_best"]) == (True, 11.9, None)
