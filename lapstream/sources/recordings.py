"""Recorded feeds: text lines in, feed events out.

A feed event is ``session_id, seq, topic, payload VARIANT, ts, session_time,
is_snapshot``. Order is ``seq``, the order of arrival; nothing sorts by time.
"""

from __future__ import annotations

import ast
import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapstream.functions.text import parse_timestamp
from lapstream.session import cut_lineage

# Topics of the feed.
TOPICS = (
    "Heartbeat",
    "CarData.z",
    "Position.z",
    "ExtrapolatedClock",
    "TopThree",
    "RcmSeries",
    "TimingStats",
    "TimingAppData",
    "WeatherData",
    "TrackStatus",
    "DriverList",
    "RaceControlMessages",
    "SessionInfo",
    "SessionData",
    "SessionStatus",
    "LapCount",
    "TimingData",
    "TeamRadio",
    "AudioStreams",
    "ContentStreams",
)

# A line's place: its split's start in units of 1 KiB, then its number within the task.
SPLIT_UNIT, LINE_BITS = 1024, 28

# Fixed value: how a JSON list begins whose first element is a string.
JSON_START = r'^[ \t\r\n]*\[[ \t\r\n]*"'

DECODED = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("is_text", T.BooleanType()),
        T.StructField("ts", T.StringType()),
    ]
)


def session_of(file_path: Column, path: str) -> Column:
    """Session of a file: its path below the folder that ``path`` names before any
    pattern, without the extension. Files of one name in two folders stay apart."""
    root = re.split(r"[*?{\[]", path, maxsplit=1)[0].rpartition("/")[0]
    root = re.sub(r"^\w+:/*", "/", root) + "/"
    start = F.instr(file_path, root)
    below = F.when(start > 0, F.substr(file_path, start + len(root))).otherwise(file_path)
    named = below if root != "/" else F.substring_index(file_path, "/", -1)
    return F.regexp_replace(named, r"\.[^./]*$", "")


def scan_recording(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, seq, line)`` of every non-blank line; one file is one session.

    ``seq`` grows along the file without a shuffle: splits of a file are ordered
    by where they start, lines within a split by the task's running number. A split
    with more lines than the number has room for stops the read.
    """
    counted = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    split = F.floor(F.col("_metadata.file_block_start") / SPLIT_UNIT)
    whole = F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    room = (F.col("number") < (1 << LINE_BITS)) | F.col("whole")
    return (
        spark.read.text(path)
        .select(
            session_of(F.col("_metadata.file_path"), path).alias("session_id"),
            split.alias("split"),
            counted.alias("number"),
            whole.alias("whole"),
            F.col("value").alias("line"),
        )
        .select(
            "session_id",
            F.when(room, F.shiftleft("split", LINE_BITS) + F.col("number"))
            .otherwise(F.raise_error(F.lit("more lines in a split than line numbers")))
            .alias("seq"),
            "line",
        )
        .where(F.trim("line") != "")
    )


# Strings without escapes or the other kind of quote, and bare words, of a Python literal.
_TOKEN = re.compile(r"""'([^'"\\]*)'|"[^"\\]*"|[A-Za-z_]+""")
_WORDS = {"True": "true", "False": "false", "None": "null"}
_SHALLOW = 64
_dumps = json.JSONEncoder(default=str).encode


def _as_json(found: re.Match) -> str:
    if found.lastindex:
        return f'"{found[1]}"'
    return found[0] if found[0][0] == '"' else _WORDS.get(found[0], "?")


def _plain_literal(line: str):
    """Value of a literal that differs from JSON in quotes and flags only; others raise ValueError.

    Compiling a literal takes several times as long. What is not surely the same in both
    notations (escapes, other words, deep nesting) is left to the compiler.
    """
    if "\\" in line or line.count("[") + line.count("{") > _SHALLOW:
        raise ValueError("not a plain literal")
    return json.loads(_TOKEN.sub(_as_json, line))


def read_line(line: str) -> tuple[str, str, bool, str | None] | None:
    """One recorded ``[topic, data, timestamp]`` line: a Python literal, else JSON."""
    try:
        row = _plain_literal(line.strip())
    except ValueError:
        try:
            row = ast.literal_eval(line.strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            try:
                row = json.loads(line)
            except ValueError:
                return None
    if not isinstance(row, list | tuple) or len(row) < 2:
        return None
    text = isinstance(row[1], str)
    stamp = str(row[2]) if len(row) > 2 else None
    return str(row[0]), row[1] if text else _dumps(row[1]), text, stamp


@F.pandas_udf(DECODED)
def _read_lines(lines: pd.Series) -> pd.DataFrame:
    nothing = (None, None, None, None)
    rows = [nothing if x is None else read_line(x) or nothing for x in lines]
    return pd.DataFrame(rows, columns=["topic", "payload", "is_text", "ts"])


# Not deterministic to the optimizer, which would else copy the call below each filter
# on its result and read every line more than once.
_decode = _read_lines.asNondeterministic()


def _json_line(line: Column) -> Column:
    """Array of a line that is JSON and means the same as a literal: without escapes.

    Lines that cannot start with a JSON string are not tried: a failed parse costs far more
    than a good one.
    """
    return F.when(line.rlike(JSON_START) & ~F.contains(line, F.lit("\\")), F.try_parse_json(line))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Add ``topic, payload, is_text, ts_raw``; ``topic`` is NULL where unreadable.

    JSON lines are taken apart by Spark; only other lines are handed to Python.
    """

    def part(i: int, kind: str) -> Column:
        return F.try_variant_get("_v", f"$[{i}]", kind)

    def is_string(i: int) -> Column:
        return F.coalesce(F.schema_of_variant(part(i, "variant")) == "STRING", F.lit(False))

    opened = lines.withColumn("_v", _json_line(F.col("line")))
    opened = opened.withColumn("_native", is_string(0) & part(1, "variant").isNotNull())
    native = F.struct(
        part(0, "string").alias("topic"),
        F.when(is_string(1), part(1, "string")).otherwise(F.to_json(part(1, "variant"))).alias("payload"),
        is_string(1).alias("is_text"),
        part(2, "string").alias("ts"),
    )
    both = opened.withColumn("_p", _decode(F.when(~F.col("_native"), F.col("line"))))
    both = both.withColumn("_d", F.when(F.col("_native"), native).otherwise(F.col("_p")))
    return both.select(
        *lines.columns, "_d.topic", "_d.payload", "_d.is_text", F.col("_d.ts").alias("ts_raw")
    )


def readable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("topic").isNotNull())


def quarantine(decoded: DataFrame) -> DataFrame:
    """Lines nothing could be read from, kept instead of lost."""
    return decoded.where(F.col("topic").isNull())


@F.pandas_udf(T.StringType())
def _inflate(blobs: pd.Series) -> pd.Series:
    """Raw-deflate bytes to text; NULL where the bytes are damaged."""

    def one(blob: bytes | None) -> str | None:
        try:
            return None if blob is None else zlib.decompress(blob, -zlib.MAX_WBITS).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return blobs.map(one)


inflate = _inflate.asNondeterministic()


def is_packed(topic: Column) -> Column:
    return topic.endswith(".z")


def plain_topic(topic: Column) -> Column:
    return F.regexp_replace(topic, r"\.z$", "")


def text_payload(text: Column) -> Column:
    """A payload given as text: the JSON it spells, or else the text itself."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def packed_payload(text: Column, packed: Column) -> Column:
    """Payload of a packed topic; rows that are not packed hand no bytes to Python."""
    blob = F.when(packed, F.try_to_binary(text, F.lit("base64")))
    return F.try_parse_json(inflate(blob))


def to_events(decoded: DataFrame) -> DataFrame:
    """Feed events from decoded lines; packed payloads that cannot be read are dropped.

    One pass: lines are decoded once, whatever their topic.
    """
    good = readable(decoded)
    packed = is_packed(F.col("topic")) & F.col("is_text")
    text = F.col("payload")
    plain = F.when(F.col("is_text"), text_payload(text)).otherwise(F.try_parse_json(text))
    opened = good.withColumns({"_packed": packed, "_opened": packed_payload(text, packed)})
    opened = opened.where(~F.col("_packed") | F.col("_opened").isNotNull())
    return opened.select(
        "session_id",
        "seq",
        plain_topic(F.col("topic")).alias("topic"),
        F.when(F.col("_packed"), F.col("_opened")).otherwise(plain).alias("payload"),
        parse_timestamp(F.col("ts_raw")).alias("ts"),
    ).withColumn("is_snapshot", F.col("ts").isNull())


def with_session_time(events: DataFrame) -> DataFrame:
    """Time since the session's first stamped event, first in order and not in time.

    The first stamp is one combined aggregate row per session, joined back.
    """
    stamped = events.where(F.col("ts").isNotNull())
    first = stamped.groupBy("session_id").agg(F.min_by("ts", "seq").alias("_start"))
    return (
        events.join(first, "session_id", "left")
        .withColumn("session_time", F.col("ts") - F.col("_start"))
        .drop("_start")
    )


def skip_to(events: DataFrame, offset: Column) -> DataFrame:
    """Drop what happened before an offset; events without a time stay."""
    return events.where(F.col("session_time").isNull() | (F.col("session_time") >= offset))


def warp_until(events: DataFrame, offset: Column) -> DataFrame:
    """Keep everything and mark what a viewer catches up on before the offset."""
    return events.withColumn(
        "warping", F.coalesce(F.col("session_time") < offset, F.lit(False))
    )


def subscribe(events: DataFrame, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """Only the wanted topics; reaches the scan as a pushed filter."""
    return events.where(F.col("topic").isin(*[t.removesuffix(".z") for t in topics]))


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Recording file(s) straight to feed events with session time.

    Lines are decoded once; the events are written by topic, so that whoever wants some
    topics reads only those.
    """
    decoded = to_events(decode_lines(scan_recording(spark, path)))
    return with_session_time(cut_lineage(decoded, "events", ("topic",)))


def capture(stream: DataFrame, column: str, path: str, checkpoint: str):
    """Append-only raw capture, one message per line. Start it with ``.start()``."""
    return (
        stream.select(F.col(column).alias("value"))
        .writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
