"""Lap completion on a stream, with keyed state.

A status change concerns every car of a session, so cars could only be tracked
together. Status rows are rare: they are copied to each of a fixed number of
shards, and a session's cars are spread over the shards. A hot session then runs
in as many tasks as there are shards, each seeing every status change.

Changes reach the state packed: a task of the scan gathers its rows by session and
shard, so a row of the shuffle holds a list per field. The state operator hands rows
over one by one, at a cost that would exceed the fold's; a micro-batch of a shard is
folded as arrays, sorted by car and ``seq``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from lapstream.functions.text import COMPOUND_CODES, TRACK_STATUS_NAMES, interval_seconds
from lapstream.operators import fold
from lapstream.operators.laps import CONTEXT

SHARDS = 16
#: Rows a task gathers before it packs them.
PACK_ROWS = 1 << 17

ROW_FIELDS = (
    "session_id", "shard", "car", "seq", "kind", "completes_lap", "lap_time", "seconds", *CONTEXT,
    "stint", "compound", "total_laps", "tla", "team", "status",
)

KINDS = ("timing", "stint", "name", "status")
TIMING, STINT, _, STATUS = range(len(KINDS))
COMPOUNDS, CODES = tuple(COMPOUND_CODES), tuple(TRACK_STATUS_NAMES)
#: A number that was not sent.
NONE = np.iinfo(np.int64).min
NUMBERS = ("seq", "laps_completed", "position", "stint", "total_laps")
FLAGS = ("completes_lap", "in_pit", "pit_out", "retired", "stopped")
NAMED = {"kind": KINDS, "compound": COMPOUNDS, "status": CODES}
TEXTS = ("car", "gap_to_leader", "interval_text", "tla", "team")
SPANS = ("lap_time", "seconds")
PACKED_TYPES = (
    dict.fromkeys(TEXTS, "string") | dict.fromkeys(NUMBERS, "bigint") | dict.fromkeys(SPANS, "double")
    | dict.fromkeys((*FLAGS, *NAMED), "tinyint")
)
PACKED = ", ".join(["session_id string, shard int", *(f"{c} array<{t}>" for c, t in PACKED_TYPES.items())])

LAPS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("driver", T.StringType()),
        T.StructField("tla", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("lap", T.LongType()),
        T.StructField("lap_time", T.DoubleType()),
        T.StructField("compound", T.StringType()),
        T.StructField("tyre_age", T.LongType()),
        T.StructField("stint", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("interval_text", T.StringType()),
        T.StructField("gap_to_leader", T.StringType()),
        T.StructField("track_statuses", T.ArrayType(T.StringType())),
        T.StructField("entered_pit", T.BooleanType()),
        T.StructField("exited_pit", T.BooleanType()),
        T.StructField("retired", T.BooleanType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)
#: Cars of a shard are kept in so many blocks: a call to the state costs more than a block's text.
BLOCKS = 16
BLOCK_KEY = T.StructType([T.StructField("block", T.IntegerType())])
TEXT_VALUE = T.StructType([T.StructField("text", T.StringType())])


def _seconds(time: Column) -> Column:
    """An interval as seconds, the form in which it goes through keyed state."""
    parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    return sum(F.extract(F.lit(p), time).cast("double") * s for p, s in parts.items())


def lap_rows(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Everything a lap depends on, one row per change, with its shard.

    Timing rows that neither complete a lap nor change what a lap records stay out.
    """
    matters = F.col("completes_lap") | F.coalesce(*[F.col(c).cast("string") for c in CONTEXT]).isNotNull()
    timing = fold.timing_deltas(events).select(
        "session_id", "car", "seq", "completes_lap", "lap_time", *CONTEXT,
        _seconds(F.col("session_time")).alias("seconds"),
    ).where(matters).withColumn("kind", F.lit("timing"))
    stints = fold.stint_deltas(events).select(
        "session_id", "car", "seq", "stint", "compound", "total_laps"
    ).withColumn("kind", F.lit("stint"))
    names = fold.driver_deltas(events).select(
        "session_id", "car", "seq", "tla", "team"
    ).withColumn("kind", F.lit("name"))
    cars = timing.unionByName(stints, allowMissingColumns=True)
    cars = cars.unionByName(names, allowMissingColumns=True)
    cars = cars.withColumn("shard", F.pmod(F.hash("car"), F.lit(shards)))
    status = fold.session_deltas(events).where(F.col("status").isNotNull()).select(
        "session_id", "seq", "status", F.lit("status").alias("kind"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    return cars.unionByName(status, allowMissingColumns=True).select(*ROW_FIELDS)


def _coded(name: str, values: pa.ChunkedArray) -> pa.ChunkedArray:
    """A column as it travels: numbers and flags have a value that stands for NULL."""
    if name in NUMBERS:
        return pc.fill_null(values, int(NONE))
    if name in FLAGS:
        return pc.fill_null(values.cast(pa.int8()), -1)
    if name in NAMED:
        return pc.fill_null(pc.index_in(values, value_set=pa.array(NAMED[name])), -1).cast(pa.int8())
    return values


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather rows by session and shard: one row per key and ``PACK_ROWS`` rows, a list per field."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACK_ROWS:
            yield _packed(held)
            held, size = [], 0
    if size:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    session = table["session_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    shard = table["shard"].to_numpy()
    order = np.lexsort((shard, session))
    session, shard = session[order], shard[order]
    first = np.flatnonzero(np.r_[True, (session[1:] != session[:-1]) | (shard[1:] != shard[:-1])])
    table = table.take(pa.array(order))
    ends = pa.array(np.r_[first, len(order)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, _coded(c, table[c]).combine_chunks()) for c in PACKED_TYPES]
    keys = table.select(["session_id", "shard"]).take(pa.array(first)).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [*(keys[c].combine_chunks() for c in keys.column_names), *lists], ["session_id", "shard", *PACKED_TYPES]
    )


#: What is known of a car between micro-batches, with what holds before anything was sent.
CAR_START = {
    "laps_completed": 0, "position": NONE, "gap_to_leader": None, "interval_text": None,
    "in_pit": 0, "pit_out": 0, "retired": 0, "stopped": 0, "tla": None, "team": None,
    "stint": NONE, "compound": -1, "total_laps": NONE, "pit_seen": -1, "out_seen": -1,
    "last_lap": NONE, "prev_seq": NONE, "prev_in_pit": 0, "prev_pit_out": 0,
}


def _array(name: str, values: list) -> np.ndarray:
    return np.array(values, object if name in TEXTS else np.int64)


class Cars:
    """Rows of a micro-batch sorted by car and ``seq``, and the cars as they were before it.

    ``known`` has an array per field of :data:`CAR_START`, a place per car.
    """

    def __init__(self, rows: dict[str, np.ndarray], car: np.ndarray, known: dict[str, np.ndarray]) -> None:
        order = np.lexsort((rows["stint"], rows["kind"] == TIMING, rows["seq"], car))
        self.rows, self.car, self.known = {c: v[order] for c, v in rows.items()}, car[order], known
        self.place = np.arange(len(car))
        new = np.r_[True, self.car[1:] != self.car[:-1]]
        self.start = np.maximum.accumulate(np.where(new, self.place, 0))
        self.last = np.flatnonzero(np.r_[new[1:], True])

    def as_of(self, at: np.ndarray, sent: np.ndarray, values: np.ndarray, before: np.ndarray, since=None) -> np.ndarray:
        """Value of the latest row up to ``at`` for which ``sent`` holds, else what was known before."""
        latest = np.maximum.accumulate(np.where(sent, self.place, -1))[at]
        since = self.start if since is None else since
        return np.where(latest >= since[at], values[latest], before[self.car[at]])

    def tyres(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """The highest stint so far, and the latest compound and age sent with it."""
        rows, old = self.rows, self.known["stint"]
        ranks, rank = np.unique(np.r_[NONE, old, np.where(rows["kind"] == STINT, rows["stint"], NONE)], return_inverse=True)
        held, rank = rank[1 : len(old) + 1], rank[len(old) + 1 :]
        top = np.maximum.accumulate(self.car * len(ranks) + np.maximum(rank, held[self.car])) - self.car * len(ranks)
        moved = np.r_[True, (top[1:] != top[:-1]) | (self.car[1:] != self.car[:-1])]
        since = np.maximum.accumulate(np.where(moved, self.place, 0))
        of_top = (rank == top) & (rank > 0)
        found = {"stint": ranks[top[at]]}
        kept = top[at] == held[self.car[at]]
        for name, unset in (("compound", -1), ("total_laps", NONE)):
            value = self.as_of(at, of_top & (rows[name] != unset), rows[name], self.known[name], since)
            sent = np.maximum.accumulate(np.where(of_top & (rows[name] != unset), self.place, -1))[at] >= since[at]
            found[name] = np.where(sent | kept, value, unset)
        return found

    def state(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of a car with the rows ``at``, but for its completions."""
        rows, known = self.rows, self.known
        unset = dict.fromkeys(NUMBERS, NONE) | dict.fromkeys(FLAGS, -1)

        def latest(name: str) -> np.ndarray:
            sent = pd.notna(rows[name]) if name in TEXTS else rows[name] != unset[name]
            return self.as_of(at, sent, rows[name], known[name])

        found = {name: latest(name) for name in (*CONTEXT, "tla", "team")} | self.tyres(at)
        for name, flag in (("pit_seen", "in_pit"), ("out_seen", "pit_out")):
            found[name] = self.as_of(at, rows[flag] == 1, rows["seq"], known[name])
        return found

    def fold(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Accepted completions with the state of their cars, and the cars after the micro-batch.

        Laps below one are not counted, nor is a repeat of the lap counted last.
        """
        rows, known = self.rows, self.known
        at = np.flatnonzero((rows["kind"] == TIMING) & (rows["completes_lap"] == 1))
        lap = self.as_of(at, rows["laps_completed"] != NONE, rows["laps_completed"], known["laps_completed"]) - 1
        at, lap = at[lap >= 1], lap[lap >= 1]

        def before(values: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Value of the completion before, of the same car."""
            car = self.car[at]
            same = np.r_[False, car[1:] == car[:-1]][: len(at)]
            return np.where(same, np.r_[values[:1], values[:-1]], start[car])

        fresh = lap != before(lap, at, known["last_lap"])
        at, lap = at[fresh], lap[fresh]
        done = self.state(at) | {"lap": lap, "seq": rows["seq"][at], "car": self.car[at]}
        done |= {c: rows[c][at] for c in SPANS}
        ended = {"last_lap": lap, "prev_seq": done["seq"], "prev_in_pit": done["in_pit"], "prev_pit_out": done["pit_out"]}
        done |= {f: before(v, at, known[f]) for f, v in ended.items() if f != "last_lap"}
        after = self.state(self.last)
        final = np.flatnonzero(np.r_[done["car"][1:] != done["car"][:-1], True][: len(at)])
        for name, values in ended.items():
            after[name] = known[name].copy()
            after[name][done["car"][final]] = values[final]
        return done, after


#: Statuses by the bits of their places in :data:`CODES`.
SEEN = [[c for i, c in enumerate(CODES) if bits >> i & 1] for bits in range(1 << len(CODES))]


def track_statuses(rows: dict[str, np.ndarray], track: dict, seq: np.ndarray, prev: np.ndarray) -> list[list[str]]:
    """Statuses active from the completion before to each one; ``track`` is brought up to date.

    A status is active if it is the present one or its latest period ended since.
    """
    order = np.argsort(rows["seq"], kind="stable")
    sent, status = rows["seq"][order], np.r_[CODES.index(track.get("status", "0")), rows["status"][order]]
    changed = status[1:] != status[:-1]
    seen_rows = np.searchsorted(sent, seq, side="right")
    active = 1 << status[seen_rows].astype(np.int64)
    ends = track.get("ends", {})
    for i, code in enumerate(CODES):
        ended = np.flatnonzero(changed & (status[:-1] == i))
        end = np.r_[ends.get(code, -1), sent[ended]]
        since = end[np.searchsorted(ended, seen_rows)]
        active |= ((prev != NONE) & (since > prev)).astype(np.int64) << i
        if len(ended):
            ends[code] = int(end[-1])
    track.update(status=CODES[status[-1]], ends=ends)
    return [SEEN[bits] for bits in active.tolist()]


def _block(name: str | None) -> int:
    return zlib.crc32(json.dumps(name).encode()) % BLOCKS


class LapProcessor(StatefulProcessor):
    """Keyed by (session, shard): a track timeline, and the cars in blocks, by name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.track = handle.getValueState("track", TEXT_VALUE)
        self.cars = handle.getMapState("cars", BLOCK_KEY, TEXT_VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = {c: np.concatenate([x for f in frames for x in f[c]]) for c in PACKED_TYPES}
        del frames
        of_track = batch["kind"] == STATUS
        statuses = {c: batch[c][of_track] for c in ("seq", "status")}
        track = json.loads(self.track.get()[0]) if self.track.exists() else {}
        done = None
        if not of_track.all():
            batch = {c: v[~of_track] for c, v in batch.items()}
            car, names = pd.factorize(batch["car"], use_na_sentinel=False)
            names = [None if pd.isna(x) else x for x in names]
            blocks, known = self.known(names)
            done, after = Cars(batch, car, known).fold()
            self.keep(names, blocks, after)
        seq, prev = (done["seq"], done["prev_seq"]) if done else (np.empty(0, np.int64),) * 2
        seen = track_statuses(statuses, track, seq, prev)
        self.track.update((json.dumps(track),))
        if seen:
            yield lap_records(key[0], names, done, seen)

    def known(self, names: list) -> tuple[dict[int, dict], dict[str, np.ndarray]]:
        """The blocks that hold the cars, and the cars by field; only cars asked for are read."""
        found = {}
        for block in {_block(name) for name in names}:
            text = self.cars.getValue((block,))
            found[block] = json.loads(text[0]) if text else {}
        start = json.dumps([*CAR_START.values()])
        held = [json.loads(found[_block(name)].get(json.dumps(name), start)) for name in names]
        return found, {f: _array(f, v) for f, v in zip(CAR_START, zip(*held, strict=True), strict=True)}

    def keep(self, names: list, blocks: dict[int, dict], after: dict[str, np.ndarray]) -> None:
        for name, *car in zip(names, *(after[f].tolist() for f in CAR_START), strict=True):
            blocks[_block(name)][json.dumps(name)] = json.dumps(car)
        for block, cars in blocks.items():
            self.cars.updateValue((block,), (json.dumps(cars),))

    def close(self) -> None:
        pass


def lap_records(session: str | None, names: list, done: dict[str, np.ndarray], seen: list[list[str]]) -> pd.DataFrame:
    """Lap records of the accepted completions of a session."""
    def text(name: str, missing: str | None) -> list:
        return [x or missing for x in done[name].tolist()]

    def number(name: str, missing: int) -> np.ndarray:
        return np.where(done[name] == NONE, missing, done[name])

    def whole(name: str) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(done[name].astype(np.int64), done[name] == NONE)

    since = np.where(done["prev_seq"] == NONE, -1, done["prev_seq"])
    compound = np.array([*COMPOUNDS, "UNKNOWN"], object)
    return pd.DataFrame({
        "session_id": [session] * len(seen),
        "driver": [names[i] for i in done["car"].tolist()],
        "tla": text("tla", ""),
        "team": text("team", ""),
        "seq": whole("seq"),
        "lap": done["lap"],
        "lap_time": done["lap_time"],
        "compound": compound[done["compound"].astype(np.int64)],
        "tyre_age": number("total_laps", 0),
        "stint": number("stint", 0),
        "position": whole("position"),
        "interval_text": done["interval_text"],
        "gap_to_leader": text("gap_to_leader", None),
        "track_statuses": seen,
        "entered_pit": (done["prev_in_pit"] == 1) | (done["pit_seen"] > since),
        "exited_pit": (done["prev_pit_out"] == 1) | (done["out_seen"] > since),
        "retired": (done["retired"] == 1) | (done["stopped"] == 1),
        "seconds": done["seconds"],
    }, columns=LAPS.fieldNames())


def stream_laps(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Lap records of a stream of feed events, as they are completed.

    Rows of one micro-batch are taken in ``seq`` order; batches must follow the
    feed's order, as files of a capture do. Append mode.
    """
    found = (
        lap_rows(events, shards)
        .mapInArrow(pack, PACKED)
        .groupBy("session_id", "shard")
        .transformWithStateInPandas(
            statefulProcessor=LapProcessor(),
            outputStructType=LAPS,
            outputMode="Append",
            timeMode="None",
        )
    )
    zero = F.lit(0)
    return (
        found.withColumn("interval", interval_seconds(F.col("interval_text")))
        .withColumn("session_time", F.make_dt_interval(zero, zero, zero, F.col("seconds")))
        .drop("interval_text", "seconds")
    )
