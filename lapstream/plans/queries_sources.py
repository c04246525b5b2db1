"""Sources, sinks and scalar functions (inventory groups A and B).

Recorded lines, frames and odd spellings are derived from ``events`` row by row;
the SQL states the value each of them stands for.
"""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapstream.functions import race, text
from lapstream.operators import fold, tree
from lapstream.plans import standins
from lapstream.plans.oracle_views import FEED, LAPS, MSG, PHASE, RACES
from lapstream.plans.queries_feed import SENT
from lapstream.plans.queries_history import LISTS, _history, _listed
from lapstream.plans.registry import query, r6
from lapstream.session import cut_lineage, scratch_path
from lapstream.sources import frames, history, predictions, recordings


def _stamp(fraction="SSSSSS"):
    """Seven fractional digits and a Z, as on the feed."""
    return F.concat(F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss.{fraction}"), F.lit("7Z"))


def _literal(body):
    """JSON flags as Python writes them; texts that spell a flag stay."""
    for json, python in (("true", "True"), ("false", "False")):
        body = F.regexp_replace(body, rf"([:\[,]){json}(?=[,\]}}])", f"$1{python}")
    return body


def _lines(spark, sf_dir):
    """Recorded lines: Python literals, JSON for some, and junk for k = 99."""
    rows = standins.messages(spark, sf_dir)
    literal = F.concat(
        F.lit("['"), F.col("topic"), F.lit("', "),
        _literal(F.col("payload_json")),
        F.lit(", '"), F.when(F.col("k") < 3, "").otherwise(_stamp()), F.lit("']"),
    )
    plain = F.concat(
        F.lit('["'), F.col("topic"), F.lit('", '), F.col("payload_json"), F.lit(', "'),
        F.when(F.col("k") < 3, "").otherwise(_stamp()), F.lit('"]'),
    )
    # A snapshot carries its payload as one JSON string.
    quoted = F.concat(
        F.lit("['"), F.col("topic"), F.lit("', '"), F.col("payload_json"), F.lit("', '']")
    )
    line = (
        F.when(F.col("k") == 99, "not [ a line")
        .when(F.col("k") % 10 == 5, plain)
        .when(F.col("k") < 2, quoted)
        .otherwise(literal)
    )
    return rows.select("session_id", "seq", line.alias("line"))


READ = "k <> 99"


@query(
    "a1_scan_recording",
    f"""WITH {MSG} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place,
      seq AS said, k = 99 AS junk FROM msg""",
)
def scan_recording(spark, sf_dir):
    """Numbered lines written as one text file per session, then scanned back in order."""
    path = scratch_path(spark, "recording")
    lines = _lines(spark, sf_dir).withColumn("file", F.col("session_id")).repartition("file")
    numbered = F.concat(F.col("seq").cast("string"), F.lit("\t"), "line").alias("value")
    lines.sortWithinPartitions("file", "seq").select("file", numbered).write.partitionBy("file").text(path)
    found = recordings.scan_recording(spark, f"{path}/*/*.txt")
    along = Window.partitionBy("session_id").orderBy("seq")
    return found.select(
        F.regexp_extract("session_id", "^file=([^/]+)/", 1).alias("session_id"),
        F.row_number().over(along).alias("place"),
        F.substring_index("line", "\t", 1).cast("bigint").alias("said"),
        (F.substring_index("line", "\t", -1) == "not [ a line").alias("junk"),
    )


@query(
    "a2_decode_lines",
    f"""WITH {MSG}, sent AS ({SENT})
    SELECT m.session_id, m.seq, m.topic, CASE WHEN k >= 3 THEN epoch_us(ts) END AS micros,
      coalesce(string_agg(path || '=' || sent.value, ';' ORDER BY path || '=' || sent.value), '') AS fields
    FROM msg m LEFT JOIN sent ON sent.session_id = m.session_id AND sent.seq = m.seq AND sent.value IS NOT NULL
    WHERE {READ} GROUP BY m.session_id, m.seq, m.topic, k, ts""",
)
def decode_lines(spark, sf_dir):
    """Lines with all they carry: topic, stamp, and every field of the payload."""
    decoded = recordings.readable(recordings.decode_lines(_lines(spark, sf_dir))).drop("line")
    # Fields, topics and stamps are read from it apart; lines are decoded once.
    decoded = cut_lineage(decoded, "decoded")
    stamp = F.unix_micros(text.parse_timestamp(F.col("ts_raw")).cast("timestamp"))
    return _with_fields(recordings.to_events(decoded)).join(
        decoded.select("session_id", "seq", stamp.alias("micros")), ["session_id", "seq"]
    )


def _with_fields(events):
    """session_id, seq, topic and the leaves of each payload as one text."""
    scalars = F.filter("leaves", lambda x: x.kind == tree.SCALAR)
    shown = F.transform(scalars, lambda x: F.concat(F.array_join(x.path, "/"), F.lit("="), x.value))
    leaves = tree.leaves_by_payload(events).select("session_id", "seq", shown.alias("shown"))
    gathered = F.flatten(F.collect_list("shown"))
    fields = leaves.groupBy("session_id", "seq").agg(F.array_join(F.sort_array(gathered), ";").alias("fields"))
    return events.select("session_id", "seq", "topic").join(fields, ["session_id", "seq"], "left").select(
        "session_id", "seq", "topic", F.coalesce("fields", F.lit("")).alias("fields")
    )


@query("a2_quarantine", f"WITH {MSG} SELECT session_id, seq FROM msg WHERE k = 99")
def quarantine(spark, sf_dir):
    decoded = recordings.decode_lines(_lines(spark, sf_dir))
    return recordings.quarantine(decoded).select("session_id", "seq")


@query(
    "a3_parse_timestamp",
    f"WITH {FEED} SELECT seq, CASE WHEN k > 0 THEN epoch_us(ts) END AS micros FROM feed",
)
def parse_timestamp(spark, sf_dir):
    raw = F.when(F.col("k") == 0, "soon").otherwise(F.concat(F.lit(" "), _stamp()))
    parsed = text.parse_timestamp(raw).cast("timestamp")
    return standins.feed(spark, sf_dir).select("seq", F.unix_micros(parsed).alias("micros"))


def _read(spark, sf_dir):
    decoded = recordings.decode_lines(_lines(spark, sf_dir))
    return recordings.with_session_time(recordings.to_events(decoded))


@query(
    "a4_text_payload",
    f"""WITH {MSG} SELECT session_id, seq, CASE topic WHEN 'TrackStatus'
        THEN CAST(k % 9 AS VARCHAR) END AS status, k < 3 AND k <> 99 AS is_snapshot
      FROM msg WHERE {READ} AND topic = 'TrackStatus'""",
)
def text_payload(spark, sf_dir):
    """Status out of payloads that came as objects and as JSON strings."""
    rows = _read(spark, sf_dir).where("topic = 'TrackStatus'")
    return rows.select(
        "session_id", "seq",
        F.try_variant_get("payload", "$.Status", "string").alias("status"), "is_snapshot",
    )


@F.pandas_udf(T.StringType())
def _deflate(values: pd.Series) -> pd.Series:
    def one(value: str) -> str:
        packer = zlib.compressobj(wbits=-zlib.MAX_WBITS)
        return base64.b64encode(packer.compress(value.encode()) + packer.flush()).decode()

    return values.map(one)


@query(
    "a5_inflate_topic",
    f"""WITH {MSG} SELECT session_id, seq, 'CarData' AS topic, round(value, 6) AS value FROM msg
      WHERE k > 0""",
)
def inflate_topic(spark, sf_dir):
    """Packed payloads; those of k = 0 are damaged and must be dropped."""
    rows = standins.feed(spark, sf_dir)
    packed = _deflate(F.to_json(F.struct("value")))
    decoded = rows.select(
        F.col("session_id").cast("string").alias("session_id"),
        "seq",
        F.lit("CarData.z").alias("topic"),
        F.when(F.col("k") == 0, "damaged").otherwise(packed).alias("payload"),
        F.lit(True).alias("is_text"),
        _stamp().alias("ts_raw"),
    )
    events = recordings.to_events(decoded)
    value = F.try_variant_get("payload", "$.value", "double")
    return events.select("session_id", "seq", "topic", r6(value).alias("value"))


def _stamped(spark, sf_dir):
    """Events of which every k < 3 has no time stamp."""
    rows = standins.feed_events(spark, sf_dir).drop("ts", "is_snapshot", "payload")
    times = standins.feed(spark, sf_dir).select(
        "seq", F.when(F.col("k") >= 3, F.col("ts")).alias("ts")
    )
    return rows.join(times, "seq").withColumn("is_snapshot", F.col("ts").isNull())


CLOCK = """clock AS (
  SELECT session_id, seq, topic, CASE WHEN k >= 3 THEN epoch_us(ts) END
      - first_value(CASE WHEN k >= 3 THEN epoch_us(ts) END IGNORE NULLS)
        OVER (PARTITION BY session_id ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS micros
  FROM msg)"""
DAY = 86_400_000_000


def _micros():
    day = F.expr("extract(day from session_time) * 86400L")
    clock = F.expr(
        "extract(hour from session_time) * 3600L + extract(minute from session_time) * 60L"
    )
    second = F.expr("cast(extract(second from session_time) * 1000000 as bigint)")
    return ((day + clock) * 1_000_000 + second).alias("micros")


@query("a6_session_time", f"WITH {MSG}, {CLOCK} SELECT session_id, seq, micros FROM clock")
def session_time(spark, sf_dir):
    timed = recordings.with_session_time(_stamped(spark, sf_dir))
    return timed.select("session_id", "seq", _micros())


@query("a7_is_snapshot", f"WITH {MSG} SELECT session_id, seq, k < 3 AS is_snapshot FROM msg")
def is_snapshot(spark, sf_dir):
    return _stamped(spark, sf_dir).select("session_id", "seq", "is_snapshot")


@query(
    "a8_skip_to",
    f"WITH {MSG}, {CLOCK} SELECT session_id, seq FROM clock WHERE micros IS NULL OR micros >= {DAY}",
)
def skip_to(spark, sf_dir):
    timed = recordings.with_session_time(_stamped(spark, sf_dir))
    return recordings.skip_to(timed, F.expr("interval '1' day")).select("session_id", "seq")


@query(
    "a9_warp_until",
    f"""WITH {MSG}, {CLOCK} SELECT session_id, seq, coalesce(micros < {DAY}, FALSE) AS warping
      FROM clock""",
)
def warp_until(spark, sf_dir):
    timed = recordings.with_session_time(_stamped(spark, sf_dir))
    marked = recordings.warp_until(timed, F.expr("interval '1' day"))
    return marked.select("session_id", "seq", "warping")


def _frames(spark, sf_dir):
    """One frame per message with a ping behind it; snapshots for k < 3, some junk."""
    rows = standins.messages(spark, sf_dir)
    snapshot = F.concat(
        F.lit('{"type":3,"result":{"'), F.col("topic"), F.lit('":'), F.col("payload_json"), F.lit("}}")
    )
    message = F.concat(
        F.lit('{"type":1,"target":"feed","arguments":["'), F.col("topic"), F.lit('",'),
        F.col("payload_json"), F.lit(',"'), _stamp(), F.lit('"]}'),
    )
    short = F.concat(F.lit('{"type":1,"target":"feed","arguments":["'), F.col("topic"), F.lit('"]}'))
    part = (
        F.when(F.col("k") < 3, snapshot)
        .when(F.col("k") == 98, short)
        .when(F.col("k") == 99, "{broken")
        .otherwise(message)
    )
    late = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 1000)
    return rows.select(
        "session_id",
        F.col("seq").alias("frame"),
        F.concat(part, F.lit('\x1e{"type":6}\x1e')).alias("raw"),
        late.alias("arrival"),
    )


@query(
    "a10_decode_frames",
    f"""WITH {MSG}, sent AS ({SENT})
    SELECT m.session_id, m.seq AS frame, m.topic, k < 3 AS is_snapshot,
      CASE WHEN k >= 3 THEN epoch_us(ts) END AS micros,
      coalesce(string_agg(path || '=' || sent.value, ';' ORDER BY path || '=' || sent.value), '') AS fields
    FROM msg m LEFT JOIN sent ON sent.session_id = m.session_id AND sent.seq = m.seq AND sent.value IS NOT NULL
    WHERE k < 98 GROUP BY m.session_id, m.seq, m.topic, k, ts""",
)
def decode_frames(spark, sf_dir):
    """Frames with all they carry: topic, stamp, and every field of the payload."""
    events = cut_lineage(frames.decode_frames(_frames(spark, sf_dir)), "frames")
    stamps = events.select(
        "session_id", "seq", "is_snapshot", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")
    )
    return _with_fields(events).join(stamps, ["session_id", "seq"]).select(
        "session_id", frames.frame_of(F.col("seq")).alias("frame"), "topic", "is_snapshot", "micros", "fields"
    )


@query(
    "a11_subscribe",
    f"WITH {MSG} SELECT session_id, seq, topic FROM msg WHERE topic IN ('TimingData', 'TrackStatus')",
)
def subscribe(spark, sf_dir):
    events = standins.feed_events(spark, sf_dir)
    wanted = recordings.subscribe(events, ("TimingData", "TrackStatus"))
    return wanted.select("session_id", "seq", "topic")


def _streamed_frames(spark, sf_dir):
    """The frames as a stream, read from a folder in the shared space."""
    path = scratch_path(spark, "frames")
    rows = _frames(spark, sf_dir)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(
    "a12_raw_capture",
    f"""WITH {MSG} SELECT count(*) AS lines, count(*) FILTER (k = 99) AS junk FROM msg""",
)
def raw_capture(spark, sf_dir):
    """Frames streamed into an append-only text capture, then counted."""
    out = scratch_path(spark, "capture")
    stream = _streamed_frames(spark, sf_dir)
    running = (
        recordings.capture(stream, "raw", out, scratch_path(spark, "capture-log"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    kept = spark.read.text(out)
    broken = F.col("value").startswith("{broken").cast("bigint")
    return kept.agg(F.count(F.lit(1)).alias("lines"), F.sum(broken).alias("junk"))


@query(
    "a13_one_contract",
    f"""WITH {MSG} SELECT topic, count(*) AS events FROM msg WHERE k < 98 GROUP BY topic""",
)
def one_contract(spark, sf_dir):
    """The batch decoder on a stream: same function, same rows."""
    out = scratch_path(spark, "decoded")
    events = frames.decode_frames(_streamed_frames(spark, sf_dir)).select("session_id", "seq", "topic")
    running = (
        events.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "decoded-log"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return fold.topic_census(spark.read.schema(events.schema).parquet(out))


HISTORY_TEXT = ", ".join(
    f"coalesce((SELECT string_agg(CAST(x.lap AS VARCHAR), ',' ORDER BY x.lap) FROM {source} x"
    f" WHERE x.session_id = r.session_id), '') AS {name}"
    for name, source in zip(
        LISTS,
        (
            "(SELECT * FROM flag WHERE sc)", "(SELECT * FROM flag WHERE vsc)", "sc_start",
            "vsc_start", "gone",
        ),
        strict=True,
    )
)


@query(
    "a14_load_history",
    f"""WITH {RACES} SELECT session_id // 10 AS season, session_id % 10 AS round, circuit,
      total_laps, starters, {HISTORY_TEXT} FROM race r""",
)
def load_history(spark, sf_dir):
    """History files, a JSON array of records per season, loaded back."""
    path = scratch_path(spark, "history")
    record = _history(spark, sf_dir).withColumns(
        {"season": F.floor(F.col("session_id") / 10), "round": F.col("session_id") % 10}
    )
    fields = F.struct(*[c for c in record.columns if c != "session_id"])
    files = record.groupBy(F.col("season").alias("file")).agg(
        F.to_json(F.collect_list(fields)).alias("value")
    )
    files.write.partitionBy("file").text(path)
    return _listed(history.load_history(spark, f"{path}/*/*.txt")).drop("event")


def _logged(spark, sf_dir):
    rows = standins.predictions(spark, sf_dir)
    return rows.select(
        F.col("session_id").cast("string").alias("session"),
        F.col("driver").cast("string").alias("driver"),
        "lap", "total_laps", "position", "p_top3", "p_points", "expected_position",
    )


PREDS = """preds AS (SELECT session_id, driver, max(lap) AS lap, arg_max(position, lap) AS position,
  avg(CAST(position <= 3 AS DOUBLE)) AS p_top3, avg(CAST(position <= 10 AS DOUBLE)) AS p_points,
  avg(CAST(position AS DOUBLE)) AS expected_position, max(total_laps) AS total_laps
  FROM laps WHERE lap * 2 <= total_laps GROUP BY 1, 2)"""
PRED_SQL = """SELECT CAST(session_id AS VARCHAR) AS session, CAST(driver AS VARCHAR) AS driver, lap, total_laps,
  position, round(p_top3, 6) AS p_top3, round(p_points, 6) AS p_points,
  round(expected_position, 6) AS expected_position FROM preds"""


def _shown(rows):
    return rows.select(
        "session", "driver", *[F.col(c).cast("bigint").alias(c) for c in ("lap", "total_laps", "position")],
        *[r6(c).alias(c) for c in ("p_top3", "p_points", "expected_position")],
    )


@query("a15_append_predictions", f"WITH {LAPS}, {PREDS} {PRED_SQL}")
def append_predictions(spark, sf_dir):
    """Two appends to one log, then read back."""
    path = scratch_path(spark, "predictions")
    rows = _logged(spark, sf_dir)
    even = F.col("driver").cast("bigint") % 2 == 0
    predictions.append_predictions(rows.where(even), path)
    predictions.append_predictions(rows.where(~even), path)
    return _shown(predictions.read_predictions(spark, path))


@query("a16_read_predictions", f"WITH {LAPS}, {PREDS} {PRED_SQL} WHERE driver % 3 <> 0")
def read_predictions(spark, sf_dir):
    """A log in which every third line is torn."""
    path = scratch_path(spark, "torn")
    rows = _logged(spark, sf_dir)
    whole = F.to_json(F.struct(*sorted(rows.columns)))
    torn = F.col("driver").cast("bigint") % 3 == 0
    line = F.when(torn, F.substring(whole, 1, 20)).otherwise(whole)
    rows.select(line.alias("value")).write.text(path)
    return _shown(predictions.read_predictions(spark, path))


@query(
    "a17_session_slug",
    f"""WITH {FEED} SELECT seq, CASE k % 4 WHEN 0 THEN k || '-hungarian-gp' WHEN 1 THEN 'race-' || topic
      WHEN 2 THEN 'session' ELSE 'a-b-' || k END AS slug FROM feed""",
)
def session_slug(spark, sf_dir):
    k = F.col("k")
    label = (
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" Hungarian  GP ")))
        .when(k % 4 == 1, F.concat(F.lit("--Race: "), F.upper("topic"), F.lit("!")))
        .when(k % 4 == 2, F.lit(" ?! "))
        .otherwise(F.concat(F.lit("A/b_"), k.cast("string")))
    )
    return standins.feed(spark, sf_dir).select("seq", text.session_slug(label).alias("slug"))


# --- scalar functions ---------------------------------------------------------


def _spelled(spark, sf_dir, *spellings):
    """Rows with one of several spellings, taken in turn by k."""
    k = F.col("k")
    chosen = F.lit(None).cast("string")
    for i, spelling in enumerate(spellings):
        value = F.lit(spelling) if isinstance(spelling, str) else spelling
        chosen = F.when(k % len(spellings) == i, value).otherwise(chosen)
    return standins.feed(spark, sf_dir).withColumn("raw", chosen)


def _k():
    return F.col("k").cast("string")


def _value():
    return F.col("value").cast("string")


@query(
    "b1_lap_time_seconds",
    f"""WITH {FEED} SELECT seq, round(CASE k % 6
      WHEN 0 THEN 60 + k % 60 + k / power(CAST(10 AS DOUBLE), length(CAST(k AS VARCHAR)))
      WHEN 1 THEN k + CAST(0.5 AS DOUBLE) WHEN 3 THEN CAST(nullif(k, 0) AS DOUBLE) END, 6) AS seconds
    FROM feed""",
)
def lap_time_seconds(spark, sf_dir):
    clock = F.concat(F.lit("1:"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"), F.lit("."), _k())
    rows = _spelled(
        spark, sf_dir, clock, F.concat(_k(), F.lit(".5")), "", F.concat(F.lit(" "), _k(), F.lit(" ")),
        F.concat(F.lit("x"), _k()), "0:00.000",
    )
    return rows.select("seq", r6(text.lap_time_seconds(F.col("raw"))).alias("seconds"))


@query(
    "b2_interval_seconds",
    f"""WITH {FEED} SELECT seq, round(CASE WHEN k % 7 IN (0, 1) THEN value END, 6) AS seconds FROM feed""",
)
def interval_seconds(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir, F.concat(F.lit("+"), _value()), _value(), "1L", "",
        F.concat(F.lit("LAP "), _k()), F.lit(None).cast("string"), F.concat(F.lit("-"), _value()),
    )
    return rows.select("seq", r6(text.interval_seconds(F.col("raw"))).alias("seconds"))


@query("b3_laps_down", f"WITH {FEED} SELECT seq, CASE WHEN k % 4 < 2 THEN k ELSE 0 END AS down FROM feed")
def laps_down(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir, F.concat(_k(), F.lit("L")), F.concat(_k(), F.lit(" l")),
        F.concat(F.lit("LAP "), _k()), "",
    )
    return rows.select("seq", text.laps_down(F.col("raw")).alias("down"))


@query("b5_as_bool", f"WITH {FEED} SELECT seq, k % 5 < 3 AS flag FROM feed")
def as_bool(spark, sf_dir):
    rows = _spelled(spark, sf_dir, "true", " TRUE ", "1", "0", "yes")
    return rows.select("seq", text.as_bool(F.col("raw")).alias("flag"))


@query(
    "b6_as_int",
    f"WITH {FEED} SELECT seq, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN -k END AS n FROM feed",
)
def as_int(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir, F.concat(F.lit(" "), _k()), F.concat(F.lit("+"), _k()),
        F.concat(F.lit("-"), _k()), F.concat(_k(), F.lit(".0")), "x",
    )
    return rows.select("seq", text.as_int(F.col("raw")).alias("n"))


@query(
    "b7_as_float",
    f"""WITH {FEED} SELECT seq, CASE k % 5 WHEN 0 THEN k + CAST(0.25 AS DOUBLE)
      WHEN 1 THEN CAST(-k AS DOUBLE) WHEN 2 THEN CAST(k * 10 AS DOUBLE) END AS x FROM feed""",
)
def as_float(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir, F.concat(F.lit(" "), _k(), F.lit(".25")), F.concat(F.lit("-"), _k()),
        F.concat(_k(), F.lit("e1")), "1.5f", "",
    )
    return rows.select("seq", text.as_float(F.col("raw")).alias("x"))


@query(
    "b8_parse_compound",
    f"""WITH {FEED} SELECT seq, CASE k % 5 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD'
      WHEN 3 THEN 'UNKNOWN' ELSE 'INTERMEDIATE' END AS compound FROM feed""",
)
def parse_compound(spark, sf_dir):
    rows = _spelled(spark, sf_dir, "soft", " Medium", "HARD ", "hyper", "INTERMEDIATE")
    return rows.select("seq", text.parse_compound(F.col("raw")).alias("compound"))


@query(
    "b9_compound_short",
    f"""WITH {FEED} SELECT seq, CASE k % 6 WHEN 0 THEN 'SOF' WHEN 1 THEN 'MED' WHEN 2 THEN 'HAR'
      WHEN 3 THEN 'INT' WHEN 4 THEN 'WET' ELSE '---' END AS code FROM feed""",
)
def compound_short(spark, sf_dir):
    rows = _spelled(spark, sf_dir, "SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET", "UNKNOWN")
    return rows.select("seq", text.compound_short(F.col("raw")).alias("code"))


@query("b11_is_neutralised", f"WITH {FEED} SELECT seq, k % 8 IN (4, 5, 6) AS neutralised FROM feed")
def is_neutralised(spark, sf_dir):
    code = (F.col("k") % 8).cast("string")
    return standins.feed(spark, sf_dir).select("seq", text.is_neutralised(code).alias("neutralised"))


@query(
    "b12_normalise_circuit",
    f"""WITH {FEED} SELECT seq, CASE k % 5 WHEN 0 THEN 'Miami' WHEN 1 THEN 'Monaco' WHEN 2 THEN 'Spa'
      ELSE 'unknown' END AS circuit FROM feed""",
)
def normalise_circuit(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir, "Miami Gardens", " Monte Carlo", " Spa ", "", F.lit(None).cast("string")
    )
    return rows.select("seq", text.normalise_circuit(F.col("raw")).alias("circuit"))


@query(
    "b13_race_bucket",
    f"WITH {LAPS} SELECT session_id, driver, lap, {PHASE} AS bucket FROM laps",
)
def race_bucket(spark, sf_dir):
    bucket = race.race_bucket(F.col("lap"), F.col("total_laps"))
    return standins.laps(spark, sf_dir, stints=False).select(
        "session_id", "driver", "lap", bucket.alias("bucket")
    )


@query(
    "b16_as_mapping",
    f"""WITH {FEED} SELECT seq, '0' AS key, CASE k % 3 WHEN 0 THEN CAST(k AS VARCHAR)
        ELSE '"' || topic || '"' END AS value FROM feed WHERE k % 3 < 2
      UNION ALL SELECT seq, '2', CAST(k AS VARCHAR) FROM feed WHERE k % 3 = 1
      UNION ALL SELECT seq, 'x', '"y"' FROM feed WHERE k % 3 = 0""",
)
def as_mapping(spark, sf_dir):
    rows = _spelled(
        spark, sf_dir,
        F.concat(F.lit('{"0": '), _k(), F.lit(', "x": "y"}')),
        F.concat(F.lit('["'), F.col("topic"), F.lit('", null, '), _k(), F.lit("]")),
        '"text"',
    )
    return rows.select("seq", F.explode(text.as_mapping(F.col("raw"))).alias("key", "value"))
