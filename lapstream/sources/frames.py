"""Socket frames captured raw: several JSON messages per frame, joined by 0x1E."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.text import parse_timestamp
from lapstream.sources.recordings import is_packed, packed_payload, plain_topic

# Frame syntax.
SEPARATOR = "\x1e"
SNAPSHOT, INVOCATION, FEED_TARGET = 3, 1, "feed"

# Room in ``seq`` for the messages of a frame and the topics of a message; checked.
PART_BITS, TOPIC_BITS = 16, 16


def split_frames(frames: DataFrame) -> DataFrame:
    """One row per readable message: frame columns, ``part``, ``text`` and ``message``."""
    parts = frames.select("*", F.posexplode(F.split("raw", SEPARATOR)).alias("part", "text"))
    return (
        parts.where(F.trim("text") != "")
        .withColumn("message", F.try_parse_json("text"))
        .where(F.col("message").isNotNull())
        .drop("raw")
    )


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("message", path, kind)


def frame_of(seq: Column) -> Column:
    """Frame number of an event."""
    return F.shiftright(seq, PART_BITS + TOPIC_BITS)


def _names(path: str) -> Column:
    """Keys of an object in the order in which they were sent."""
    return F.json_object_keys(F.get_json_object("text", path))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Feed events of captured frames (``session_id, frame, raw, arrival``).

    A snapshot message gives one event per topic, a feed message one event; pings,
    closes and unreadable parts give none. ``seq`` orders frame, part and topic, topics
    of a snapshot as they stand in it. A frame that does not fit into ``seq`` stops the read.
    """
    messages = split_frames(frames)
    kind = _get("$.type", "int")
    inside = messages.where(kind == SNAPSHOT).lateralJoin(
        frames.sparkSession.tvf.variant_explode(
            F.try_variant_get(F.col("message").outer(), "$.result", "variant")
        )
    )
    snapshot = inside.select(
        "session_id", "frame", "part", "arrival",
        (F.array_position(_names("$.result"), F.col("key")) - 1).alias("place"), F.col("key").alias("topic"),
        F.col("value").alias("payload"), F.lit(None).cast("string").alias("ts_raw"),
    )
    feed = messages.where(
        (kind == INVOCATION)
        & (_get("$.target", "string") == FEED_TARGET)
        & _get("$.arguments[1]", "variant").isNotNull()
    ).select(
        "session_id", "frame", "part", "arrival", F.lit(0).cast("bigint").alias("place"),
        _get("$.arguments[0]", "string").alias("topic"),
        _get("$.arguments[1]", "variant").alias("payload"),
        _get("$.arguments[2]", "string").alias("ts_raw"),
    )
    stacked = snapshot.unionByName(feed)
    packed = is_packed(F.col("topic"))
    text = F.try_variant_get("payload", "$", "string")
    opened = stacked.withColumns({"_packed": packed, "_opened": packed_payload(text, packed)})
    opened = opened.withColumn(
        "payload", F.when(F.col("_packed"), F.col("_opened")).otherwise(F.col("payload"))
    )
    ordered = F.shiftleft(F.col("frame").cast("bigint"), PART_BITS + TOPIC_BITS)
    ordered += F.shiftleft(F.col("part").cast("bigint"), TOPIC_BITS)
    fits = (
        (F.col("place") < (1 << TOPIC_BITS))
        & (F.col("part") < (1 << PART_BITS))
        & (F.col("frame") < (1 << (63 - PART_BITS - TOPIC_BITS)))
    )
    return (
        opened.where(F.col("payload").isNotNull())
        .select(
            "session_id",
            F.when(fits, ordered + F.col("place"))
            .otherwise(F.raise_error(F.lit("a frame has more messages or topics than seq has room for")))
            .alias("seq"),
            plain_topic(F.col("topic")).alias("topic"),
            "payload",
            parse_timestamp(F.col("ts_raw")).alias("ts"),
            "arrival",
        )
        .withColumn("is_snapshot", F.col("ts").isNull())
    )


def message_lag(events: DataFrame) -> DataFrame:
    """Seconds between the stamp on a message (UTC, kept without a zone) and its arrival."""
    stamped = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    micros = F.unix_micros(F.col("arrival").cast("timestamp")) - F.unix_micros(stamped)
    return events.withColumn("lag", micros / 1e6)
