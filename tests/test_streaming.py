"""Stream and batch give the same laps, however the input is cut into batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lapstream.operators import fold, laps
from lapstream.plans import standins
from lapstream.streaming import laps as stream
from lapstream.streaming import run, state

COLUMNS = (
    "session_id", "driver", "seq", "lap", "lap_time", "compound", "tyre_age", "stint", "position",
    "interval", "track_statuses", "entered_pit", "exited_pit", "retired", "tla", "team",
)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_laps_equal_batch(spark, sf_dir, tmp_path, parts):
    events = standins.feed_events(spark, sf_dir)
    batch = laps.extract_laps(
        fold.timing_deltas(events), fold.stint_deltas(events), fold.driver_deltas(events),
        fold.session_deltas(events),
    )
    raw = standins.messages(spark, sf_dir).drop("k", "car")
    last = raw.agg(F.max("seq")).first()[0] + 1
    source = str(tmp_path / "in")
    run.use_rocksdb(spark)
    for i in range(parts):
        low, high = last * i // parts, last * (i + 1) // parts
        part = raw.where((F.col("seq") >= low) & (F.col("seq") < high))
        part.coalesce(1).write.mode("append").parquet(source)
        opened = spark.readStream.schema(raw.schema).parquet(source).select(
            "session_id", "seq", "topic", F.try_parse_json("payload_json").alias("payload"), "ts"
        )
        found = stream.stream_laps(opened, shards=3)
        run.append_to(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert rows(got) == rows(batch)


def test_late_row_does_not_overwrite(spark, tmp_path):
    def part(seq, position):
        df = spark.createDataFrame(
            [("s", seq, "TimingData", f'{{"Lines": {{"1": {{"Position": "{position}"}}}}}}')],
            "session_id string, seq long, topic string, j string",
        )
        df.write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    from lapstream.streaming import state

    for seq, position in ((5, 3), (2, 9)):
        schema = part(seq, position)
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select(
            "session_id", "seq", "topic", F.parse_json("j").alias("payload"),
            F.lit(None).cast("timestamp_ntz").alias("ts"),
        )
        run.update_to(state.car_states(events), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = run.latest_updates(spark, str(tmp_path / "out"), ["session_id", "car"])
    assert [r["position"] for r in found.collect()] == [3]


def test_lag_percentiles_by_rank(spark):
    size, second = 20_000, F.timestamp_seconds(F.lit(90))
    many = spark.range(size, numPartitions=4).select(
        F.lit("a").alias("session_id"), F.timestamp_seconds(F.col("id") % 60).alias("arrival"),
        (F.col("id") * 7919 % size + 1).cast("double").alias("lag"),
    )
    few = spark.range(7).select(F.lit("b").alias("session_id"), second.alias("arrival"), F.when(F.col("id") < 5, F.col("id") * 1.5).alias("lag"))
    none = spark.range(3).select(F.lit("c").alias("session_id"), second.alias("arrival"), F.lit(None).cast("double").alias("lag"))
    every = many.unionByName(few).unionByName(none)

    def found(accuracy):
        return {r.session_id: (r.frames, r.lag_p50, r.lag_p99) for r in state.latency(every, accuracy=accuracy).collect()}

    # A lag of the large window is its own rank.
    for accuracy in (100, state.LATENCY_ACCURACY):
        frames, half, most = found(accuracy)["a"]
        assert frames == size
        assert abs(half - size * 0.5) <= size / accuracy
        assert abs(most - size * 0.99) <= size / accuracy
        assert found(accuracy)["b"] == (7, 3.0, 6.0)
        assert found(accuracy)["c"] == (3, None, None)
    assert state.latency(every.limit(0)).count() == 0
