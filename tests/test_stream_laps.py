"""Packed rows folded as arrays give what a row by row fold gives, and files reach a stream in order."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapstream import session
from lapstream.functions.text import TRACK_STATUS_NAMES
from lapstream.operators import fold, laps
from lapstream.plans import queries_streaming, standins
from lapstream.streaming import laps as stream
from lapstream.streaming import run

TYPES = {
    **dict.fromkeys(("session_id", "car", "kind", "gap_to_leader", "interval_text", "compound", "tla", "team", "status"), pa.string()),
    **dict.fromkeys(("completes_lap", "in_pit", "pit_out", "retired", "stopped"), pa.bool_()),
    **dict.fromkeys(("lap_time", "seconds"), pa.float64()), "shard": pa.int32(),
}


class Kept(dict):
    """State of one key, with a count of the calls made to it."""

    calls = 0

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    def getMapState(self, name, key, schema):  # noqa: N802
        return Value(self, name)


class Value:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def exists(self):
        return self.containsKey(())

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def containsKey(self, key):  # noqa: N802
        self.kept.calls += 1
        return (self.name, key) in self.kept

    def getValue(self, key):  # noqa: N802
        self.kept.calls += 1
        return self.kept.get((self.name, key))

    def updateValue(self, key, value):  # noqa: N802
        self.kept.calls += 1
        self.kept[self.name, key] = value


def batch_of(rows):
    return pa.table({c: pa.array([r.get(c) for r in rows], TYPES.get(c, pa.int64())) for c in stream.ROW_FIELDS}).to_batches()[0]


def folded(kept, rows):
    """Lap records of one micro-batch of a key, through packing and the processor."""
    processor = stream.LapProcessor()
    processor.init(kept)
    packed = [b.to_pandas() for i in range(0, len(rows), 100) for b in stream.pack(iter([batch_of(rows[i : i + 100])]))]
    out = []
    for found in processor.handleInputRows(("s", 0), iter(packed), None):
        out += pa.Table.from_pandas(found, preserve_index=False).to_pylist()
    return out


def plain(cars, track, rows):
    """The same, a row at a time."""
    out = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["kind"] == "status":
            if track["now"] != r["status"]:
                track["ends"][track["now"]] = r["seq"]
                track["now"] = r["status"]
            continue
        car = cars.setdefault(r["car"], {"laps": 0, "pit": -1, "out": -1})
        if r["kind"] == "stint":
            if "stint" not in car or r["stint"] > car["stint"]:
                car |= {"stint": r["stint"], "compound": None, "total_laps": None}
            if r["stint"] == car["stint"]:
                car |= {f: r[f] for f in ("compound", "total_laps") if r.get(f) is not None}
            continue
        car |= {f: r[f] for f in (*laps.CONTEXT, "tla", "team") if r.get(f) is not None}
        car["pit"] = r["seq"] if r.get("in_pit") else car["pit"]
        car["out"] = r["seq"] if r.get("pit_out") else car["out"]
        lap = car.get("laps_completed", 0) - 1
        if not r.get("completes_lap") or lap < 1 or car.get("last") == lap:
            continue
        prev = car.get("prev")
        ended = {c for c, at in track["ends"].items() if prev is not None and at > prev}
        since = -1 if prev is None else prev
        out.append({
            "session_id": "s", "driver": r["car"], "tla": car.get("tla") or "", "team": car.get("team") or "",
            "seq": r["seq"], "lap": lap, "lap_time": r.get("lap_time"), "compound": car.get("compound") or "UNKNOWN",
            "tyre_age": car.get("total_laps") or 0, "stint": car.get("stint") or 0, "position": car.get("position"),
            "interval_text": car.get("interval_text"), "gap_to_leader": car.get("gap_to_leader") or None,
            "track_statuses": [c for c in TRACK_STATUS_NAMES if c in ended or c == track["now"]],
            "entered_pit": bool(car.get("was_in")) or car["pit"] > since, "exited_pit": bool(car.get("was_out")) or car["out"] > since,
            "retired": bool(car.get("retired") or car.get("stopped")), "seconds": r.get("seconds"),
        })
        car |= {"last": lap, "prev": r["seq"], "was_in": car.get("in_pit"), "was_out": car.get("pit_out")}
    return out


def drawn(draw, seq, cars):
    def some(*values):
        return draw.choice([None, *values])

    kind = draw.choices(("timing", "stint", "name", "status"), (6, 2, 1, 2))[0]
    row = {"session_id": "s", "shard": 0, "seq": seq, "kind": kind, "completes_lap": None}
    if kind == "status":
        return row | {"status": draw.choice(list(TRACK_STATUS_NAMES))}
    row["car"] = draw.choice(cars)
    if kind == "stint":
        return row | {"stint": draw.randrange(4), "compound": some("SOFT", "WET"), "total_laps": some(0, 7, 2**60 + 1)}
    if kind == "name":
        return row | {"tla": some("ABC", "X"), "team": some("T1")}
    return row | {
        "completes_lap": draw.random() < 0.6, "lap_time": some(80.5, 91.25), "seconds": some(1.5),
        "laps_completed": some(0, 1, 2, 3, 3, 4, 2**60 + 1), "position": some(0, 4, 2**60 + 1), "gap_to_leader": some("", "+1.5"),
        "interval_text": some("", "1L", "+0.25"), **{f: some(True, False, None) for f in ("in_pit", "pit_out", "retired", "stopped")},
    }


@pytest.mark.parametrize("seed", range(6))
def test_arrays_fold_as_rows(seed):
    draw = random.Random(seed)
    names = [*map(str, range(1, 9)), "", "null", None]
    rows = [drawn(draw, seq, names) for seq in range(1200)]
    kept, cars, track = Kept(), {}, {"now": "0", "ends": {}}
    cuts = sorted({0, len(rows), *(draw.randrange(len(rows)) for _ in range(seed * 3))})
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    if seed == 5:  # A late batch.
        parts[1], parts[2] = parts[2], parts[1]
    found = 0
    for part in parts:
        draw.shuffle(part)
        got, want = folded(kept, part), plain(cars, track, part)
        key = lambda r: (r["seq"], str(r["driver"]))
        assert sorted(got, key=key) == sorted(want, key=key)
        found += len(got)
    assert found > 50


def test_state_is_called_per_block():
    """A call per car cost more than folding its rows."""
    draw = random.Random(1)
    kept = Kept()
    for low in (0, 3000):
        folded(kept, [drawn(draw, low + i, [*map(str, range(400))]) for i in range(3000)])
    assert kept.calls <= 2 * (2 * stream.BLOCKS + 3)


def test_only_status_rows():
    kept = Kept()
    rows = [{"session_id": "s", "shard": 0, "seq": i, "kind": "status", "status": str(i % 3)} for i in range(5)]
    assert folded(kept, rows) == []
    assert json.loads(kept["track", ()][0]) == {"status": "1", "ends": {"0": 4, "1": 2, "2": 3}}


def test_many_files_are_streamed_in_order(spark, tmp_path, monkeypatch):
    """Several files a micro-batch, and more of them than one step of the feed holds, whatever ends first."""
    rows = [
        (i, (i * 7) % 5, ("click", "purchase", "view", "error", "purchase")[i % 5], float(i % 90), json.dumps({"k": i * 37 % 100}))
        for i in range(900)
    ]
    schema = "event_id long, user_id long, event_type string, value double, props string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 15)
    monkeypatch.setattr(run, "FILE_ROWS", 20, raising=False)
    got = queries_streaming.stream_laps(spark, str(tmp_path))
    feed = standins.feed_events(spark, str(tmp_path))
    want = queries_streaming._shown(laps.extract_laps(
        fold.timing_deltas(feed), fold.stint_deltas(feed), fold.driver_deltas(feed), fold.session_deltas(feed)
    ))
    got, want = (sorted(map(str, df.collect())) for df in (got, want))
    assert len(want) > 50 and got == want


def test_files_that_end_first_come_last(spark, tmp_path):
    path = str(tmp_path / "out")
    dealt = run.in_order(spark.range(1000).withColumn("seq", F.pmod(F.col("id") * 7, F.lit(1000))), "seq", 3)
    run.write_in_order(dealt, path)
    files = sorted((tmp_path / "out").glob("part-*"), key=lambda f: f.stat().st_mtime)
    ends = [spark.read.parquet(str(f)).agg(F.min("seq"), F.max("seq")).first() for f in files]
    assert len(files) > run.BATCH_FILES and ends[0][0] == 0 and ends[-1][1] == 999
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
