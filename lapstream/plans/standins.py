"""Race tables derived from the driver's ``events`` table.

Every registered query reads one of these, so its work grows with ``events``.
The SQL twins of the same views live in ``oracle_views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapstream.operators.scan import ranked, running, with_chunk
from lapstream.session import cut_lineage, spread


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


Deal = Callable[[DataFrame], DataFrame]


def feed(spark: SparkSession, sf_dir: str, deal: Deal | None = None) -> DataFrame:
    """One row per event: seq, ts, wk, cohort, session_id, driver, topic, value, k.

    ``deal`` gives the events to tasks before they are read into columns.
    """
    rows = events(spark, sf_dir)
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("bigint")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return (deal(rows) if deal else rows).select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        week.alias("wk"),
        (F.col("user_id") % 10).alias("cohort"),
        (week * 10 + F.col("user_id") % 10).alias("session_id"),
        F.col("user_id").alias("driver"),
        F.col("event_type").alias("topic"),
        F.col("value"),
        k.alias("k"),
    )


def _compound(stint: Column, driver: Column, k: Column) -> Column:
    turn = (stint + driver) % 3
    dry = F.when(turn == 0, "SOFT").when(turn == 1, "MEDIUM").otherwise("HARD")
    return F.when(k == 99, "UNKNOWN").otherwise(dry)


def race_lengths(raw: DataFrame) -> DataFrame:
    """Longest car run per session, from counts combined before the shuffle."""
    per_car = raw.groupBy("session_id", "driver").agg(F.count(F.lit(1)).alias("driver_laps"))
    return per_car.groupBy("session_id").agg(F.max("driver_laps").alias("total_laps"))


def laps(
    spark: SparkSession, sf_dir: str, position: bool = False, stints: bool = True
) -> DataFrame:
    """One lap per event, with the columns lap extraction gives.

    Ranking the cars of each lap costs a further shuffle, so ``position`` is only
    added on request. Without ``stints`` the pass behind tyre age is left out.
    """
    raw = feed(spark, sf_dir)
    car = ["session_id", "driver"]
    pit = F.col("topic") == "purchase"
    entered = pit.cast("bigint")
    counted = running(
        with_chunk(raw, "seq"),
        car,
        "seq",
        number="lap",
        size="driver_laps",
        sums={"stops": entered},
        lags={"pit_before": entered},
        chunk="chunk",
    )
    exited = F.coalesce(F.col("pit_before") == 1, F.lit(False))
    staged = counted.withColumn("stint_start", F.lit(None).cast("bigint"))
    if stints:
        staged = running(
            cut_lineage(counted, "counted"),
            car,
            "seq",
            maxima={"stint_start": F.when(exited, F.col("lap"))},
            chunk="chunk",
        )
    stint = F.col("stops") - entered
    extra = F.when(F.col("value") > 200, 60.0).otherwise(0.0)
    lap_time = F.lit(80.0) + F.col("k") / 10 + extra
    is_last = F.col("lap") == F.col("driver_laps")
    timed = staged.join(race_lengths(raw), "session_id").select(
        "session_id",
        F.col("cohort").alias("circuit"),
        "driver",
        "seq",
        "lap",
        "total_laps",
        F.when((F.col("topic") != "view") | (F.col("k") >= 2), lap_time).alias("lap_time"),
        pit.alias("entered_pit"),
        exited.alias("exited_pit"),
        stint.alias("stint"),
        (
            F.col("lap")
            - F.coalesce(F.col("stint_start"), F.lit(1))
            + F.when(stint > 0, 0).otherwise(1)
        ).alias("tyre_age"),
        _compound(stint, F.col("driver"), F.col("k")).alias("compound"),
        F.when((F.col("topic") == "error") & (F.col("k") < 5), "4")
        .when((F.col("topic") == "signup") & (F.col("k") < 5), "6")
        .otherwise("1")
        .alias("status"),
        F.when(F.col("topic") != "view", F.col("value") / 10).alias("interval"),
        "value",
        "k",
        is_last.alias("is_last"),
        (is_last & (F.col("topic") == "error") & (F.col("lap") < F.col("total_laps"))).alias(
            "retired"
        ),
    )
    timed = timed.withColumn("track_statuses", F.array("status"))
    if not stints:
        timed = timed.drop("tyre_age")
    if not position:
        return timed
    return ranked(
        timed,
        ["session_id", "lap"],
        [F.col("value").desc(), F.col("driver")],
        -F.floor("value"),
        "position",
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps as a results service publishes them: race, driver, lap, status codes."""
    return laps(spark, sf_dir, stints=False).select(
        "session_id", "circuit", "driver", "lap", "status", "retired"
    )


def results(observed_laps: DataFrame) -> DataFrame:
    """One classification row per car: ``R`` for a retirement, else ``F``."""
    out = F.when(F.bool_or("retired"), "R").otherwise("F")
    return observed_laps.groupBy("session_id", "driver").agg(out.alias("classified"))


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per race: circuit, total_laps, starters."""
    per_car = (
        feed(spark, sf_dir)
        .groupBy("session_id", "cohort", "driver")
        .agg(F.count(F.lit(1)).alias("driver_laps"))
    )
    return per_car.groupBy("session_id", F.col("cohort").cast("string").alias("circuit")).agg(
        F.max("driver_laps").alias("total_laps"), F.count(F.lit(1)).alias("starters")
    )


def _number(x: Column) -> Column:
    return x.cast("string")


def _sent(when: Column, value: Column) -> Column:
    """A field that is only part of the message under a condition."""
    return F.when(when, value)


def _car_map(car: Column, line: Column) -> Column:
    return F.create_map(car, line)


def message_json() -> Column:
    """JSON payload of an event, in the shape of a real feed message.

    click: timing change   purchase: lap completion   view: tyre stint
    error: track status    signup: lap count, weather, driver or session
    """
    k, car, value = F.col("k"), F.col("car"), F.col("value")
    change = F.struct(
        _sent(k % 5 != 4, F.when(k < 3, "").otherwise(_number(k % 20 + 1))).alias("Position"),
        _sent(
            k % 4 != 0,
            F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("+"), _number(value))),
        ).alias("GapToLeader"),
        _sent(
            k % 3 != 2,
            F.struct(
                F.when(k % 3 == 0, "1L").otherwise(F.concat(F.lit("+"), _number(value))).alias("Value")
            ),
        ).alias("IntervalToPositionAhead"),
        F.when(k % 10 == 7, True).when(k % 10 == 8, False).alias("InPit"),
        F.when(k % 10 == 8, True).when(k % 10 == 9, False).alias("PitOut"),
        F.when(k == 50, "true").when(k == 51, "false").alias("Retired"),
    )
    clock = F.concat(
        F.lit("1:"), F.lpad(_number(k % 60), 2, "0"), F.lit("."), F.lpad(_number(k), 3, "0")
    )
    sector = F.struct(F.concat(_number(20 + k % 10), F.lit(".5")).alias("Value"))
    done = F.struct(
        _sent(k % 3 != 0, F.floor(k / 10)).alias("NumberOfLaps"),
        F.struct(F.when(k < 5, "").otherwise(clock).alias("Value")).alias("LastLapTime"),
        F.create_map(_number(k % 4), sector).alias("Sectors"),
    )
    tyre = F.struct(
        F.when(k % 4 == 1, "SOFT")
        .when(k % 4 == 2, "hard")
        .when(k % 4 == 3, "TEST_UNKNOWN")
        .alias("Compound"),
        _sent(k % 2 == 0, F.lit("false")).alias("New"),
        _sent(k % 5 != 0, k % 30).alias("TotalLaps"),
    )
    stints = F.struct(F.create_map(_number(F.floor(k / 34)), tyre).alias("Stints"))

    def lines(line: Column) -> Column:
        return F.to_json(F.struct(_car_map(car, line).alias("Lines")))

    lap_count = F.struct(
        F.when(k < 8, "").otherwise(_number(k)).alias("CurrentLap"),
        _sent(k % 8 == 0, F.lit(70)).alias("TotalLaps"),
    )
    weather = F.struct(
        _number(k % 10 - 1).alias("AirTemp"),
        F.when(k > 50, "x").otherwise(_number(k)).alias("TrackTemp"),
        F.when(k % 8 == 1, "1").when(k % 16 == 5, "0").alias("Rainfall"),
    )
    driver = F.struct(
        F.when(k < 10, "").otherwise(F.concat(F.lit("T"), _number(k))).alias("Tla"),
        _sent(k % 8 != 2, F.concat(F.lit("Car "), _number(k))).alias("FullName"),
        F.concat(F.lit("B"), _number(k)).alias("BroadcastName"),
        F.concat(F.lit("Team "), _number(k % 10)).alias("TeamName"),
    )
    place = F.struct(
        F.concat(F.lit("L"), _number(k)).alias("Location"),
        F.struct(
            _sent(k % 8 != 3, F.concat(F.lit("C"), _number(k))).alias("ShortName")
        ).alias("Circuit"),
    )
    session = F.struct(
        F.concat(F.lit("Race "), _number(k)).alias("Name"),
        F.lit("Race").alias("Type"),
        place.alias("Meeting"),
    )
    topic = F.col("event_type")
    return (
        F.when(topic == "click", lines(change))
        .when(topic == "purchase", lines(done))
        .when(topic == "view", lines(stints))
        .when(topic == "error", F.to_json(F.struct(_number(k % 9).alias("Status"))))
        .when(k % 4 == 0, F.to_json(lap_count))
        .when(k % 4 == 1, F.to_json(weather))
        .when(k % 4 == 2, F.to_json(F.create_map(car, driver)))
        .otherwise(F.to_json(session))
    )


def message_topic() -> Column:
    topic, turn = F.col("event_type"), F.col("k") % 4
    return (
        F.when(topic.isin("click", "purchase"), "TimingData")
        .when(topic == "view", "TimingAppData")
        .when(topic == "error", "TrackStatus")
        .when(turn == 0, "LapCount")
        .when(turn == 1, "WeatherData")
        .when(turn == 2, "DriverList")
        .otherwise("SessionInfo")
    )


def messages(spark: SparkSession, sf_dir: str, deal: Deal | None = None) -> DataFrame:
    """Feed messages as text: session_id, seq, ts, topic, payload_json.

    Rows are spread by hash, or as ``deal`` gives the events to tasks.
    """
    rows = feed(spark, sf_dir, deal)
    rows = (rows if deal else spread(rows)).withColumnRenamed("topic", "event_type")
    rows = rows.withColumn("car", _number(F.col("driver")))
    return rows.select(
        _number(F.col("session_id")).alias("session_id"),
        "seq",
        "ts",
        message_topic().alias("topic"),
        message_json().alias("payload_json"),
        "k",
        "car",
    )


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as feed events, payload opened to VARIANT."""
    return messages(spark, sf_dir).select(
        "session_id",
        "seq",
        "topic",
        F.try_parse_json("payload_json").alias("payload"),
        "ts",
        F.col("ts").isNull().alias("is_snapshot"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome draws made of laps: four options per race, a draw every four laps."""
    rows = laps(spark, sf_dir, position=True, stints=False)
    millis = F.round(F.coalesce("lap_time", F.lit(120.0)) * 1000).cast("bigint")
    rows = cut_lineage(rows.withColumn("millis_of_lap", millis), "draws")
    timed = running(rows, ["session_id", "driver"], "seq", sums={"millis": F.col("millis_of_lap")})
    return timed.select(
        "session_id",
        (F.col("lap") % 4).alias("option_id"),
        F.floor(F.col("lap") / 4).alias("draw"),
        "driver",
        (F.col("millis") / 1000).alias("elapsed"),
        "retired",
        F.col("lap").alias("retired_on"),
        "position",
        "total_laps",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per car, made from the first half of its race."""
    rows = laps(spark, sf_dir, position=True, stints=False)
    half = rows.where(F.col("lap") * 2 <= F.col("total_laps"))
    place = F.col("position")
    return half.groupBy("session_id", "driver").agg(
        F.avg((place <= 3).cast("double")).alias("p_top3"),
        F.avg((place <= 10).cast("double")).alias("p_points"),
        F.avg(place.cast("double")).alias("expected_position"),
        F.max_by("position", "lap").alias("position"),
        F.max("lap").alias("lap"),
        F.max("total_laps").alias("total_laps"),
    )


def finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish per car: rank by summed value; retired cars have none."""
    rows = laps(spark, sf_dir, stints=False)
    per_car = rows.groupBy("session_id", "driver").agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"),
        F.bool_or("retired").alias("out"),
    )
    chunk = -F.floor(F.col("score") / 1000)
    placed = ranked(
        per_car, ["session_id"], [F.desc("score"), F.col("driver")], chunk, "actual"
    )
    return placed.where(~F.col("out")).select("session_id", "driver", "actual")
