"""Column functions that read the loosely typed text of a timing feed.

All of them are built from JVM-side expressions and give NULL, never an error,
for text they cannot read. NULL means "unknown", which is not the same as zero.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the feed's text fields.
LAP_TIME_PATTERN = r"^(?:(\d+):)?(\d+)(?:\.(\d+))?$"
INTERVAL_PATTERN = r"^\+?(\d+(?:\.\d+)?)$"
LAPS_DOWN_PATTERN = r"(?i)^(\d+)\s*L$"
INTEGER_PATTERN = r"^[+-]?\d+$"
FLOAT_PATTERN = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf(inity)?)$"

# Tyre compounds and their three-letter codes.
COMPOUND_CODES = {
    "SOFT": "SOF",
    "MEDIUM": "MED",
    "HARD": "HAR",
    "INTERMEDIATE": "INT",
    "WET": "WET",
    "UNKNOWN": "---",
}
RACING_COMPOUNDS = ("SOFT", "MEDIUM", "HARD")

# Track status codes.
TRACK_STATUS_NAMES = {
    "0": "UNKNOWN",
    "1": "ALL_CLEAR",
    "2": "YELLOW",
    "3": "GREEN_RESUMED",
    "4": "SAFETY_CAR",
    "5": "RED",
    "6": "VSC",
    "7": "VSC_ENDING",
}
SAFETY_CAR, RED_FLAG, VIRTUAL_SAFETY_CAR = "4", "5", "6"
NEUTRALISED = (SAFETY_CAR, RED_FLAG, VIRTUAL_SAFETY_CAR)

# Circuits that changed their name between seasons.
CIRCUIT_ALIASES = {"Miami Gardens": "Miami", "Monte Carlo": "Monaco"}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def _blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_timestamp(x: Column) -> Column:
    """ISO text with up to seven fractional digits and a ``Z``, as TIMESTAMP_NTZ."""
    text = F.regexp_replace(F.trim(x), "Z+$", "")
    text = F.regexp_replace(text, r"([.][0-9]{6})[0-9]+$", "$1")
    return text.try_cast("timestamp_ntz")


def lap_time_seconds(x: Column) -> Column:
    """``m:ss.fff`` or ``ss.fff`` in seconds; zero and anything else is NULL.

    One pattern check, then plain splitting: cheaper than capturing the groups.
    """
    text = F.trim(x)
    rest = F.substring_index(text, ":", -1)
    minutes = F.when(text.contains(":"), F.substring_index(text, ":", 1).try_cast("bigint"))
    seconds = F.substring_index(rest, ".", 1).try_cast("bigint")
    fraction = F.when(
        rest.contains("."),
        F.concat(F.lit("0."), F.substring_index(rest, ".", -1)).try_cast("double"),
    )
    whole = F.coalesce(minutes, F.lit(0)) * 60 + seconds
    total = whole.cast("double") + F.coalesce(fraction, F.lit(0.0))
    return F.when(text.rlike(LAP_TIME_PATTERN), F.nullif(total, F.lit(0.0)))


def lap_time_number(x: Column) -> Column:
    """A lap time that arrived as a number: zero means not set."""
    return F.nullif(x.cast("double"), F.lit(0.0))


def interval_seconds(x: Column) -> Column:
    """A time gap such as ``+1.325``; lapped cars, lap markers and blanks are NULL."""
    text = F.trim(x)
    seconds = _blank_to_null(F.regexp_extract(text, INTERVAL_PATTERN, 1)).try_cast("double")
    return F.when(~F.upper(text).contains("L"), seconds)


def laps_down(x: Column) -> Column:
    """``2L`` is two laps down; every other text is on the lead lap."""
    found = _blank_to_null(F.regexp_extract(F.trim(x), LAPS_DOWN_PATTERN, 1))
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_gap(x: Column) -> Column:
    """Whether a timing field holds a gap at all, and not a lap marker."""
    text = F.trim(F.coalesce(x, F.lit("")))
    return (text != "") & ~F.upper(text).startswith("LAP")


def as_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1"), F.lit(False))


def as_int(x: Column) -> Column:
    """Strict integer text; ``1.0`` is not an integer."""
    text = F.trim(x)
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def as_float(x: Column) -> Column:
    text = F.trim(x)
    return F.when(text.rlike(FLOAT_PATTERN), text.try_cast("double"))


def parse_compound(x: Column) -> Column:
    text = F.upper(F.trim(x))
    return F.when(text.isin(*COMPOUND_CODES), text).otherwise("UNKNOWN")


def compound_short(x: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(COMPOUND_CODES), x), F.lit("---"))


def track_status_code(x: Column) -> Column:
    """Raw status text to a known code: missing and unheard-of codes are ``0``."""
    return F.when(x.isin(*TRACK_STATUS_NAMES), x).otherwise("0")


def track_status_name(x: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(TRACK_STATUS_NAMES), x), F.lit("UNKNOWN"))


def is_neutralised(code: Column) -> Column:
    """Safety car, virtual safety car or red flag."""
    return code.isin(*NEUTRALISED)


def normalise_circuit(x: Column) -> Column:
    text = F.trim(F.coalesce(_blank_to_null(x), F.lit("unknown")))
    return F.coalesce(F.try_element_at(_lookup(CIRCUIT_ALIASES), text), text)


def session_slug(x: Column) -> Column:
    """Session label as a path part: lower case, one dash per other run."""
    dashed = F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(_blank_to_null(F.regexp_replace(dashed, "^-|-$", "")), F.lit("session"))


def as_mapping(json_text: Column) -> Column:
    """A JSON object as a map, or a JSON list as a map keyed by index (no nulls).

    Values keep their JSON spelling. Everything else is an empty map.
    """
    text = F.trim(json_text)
    listed = F.filter(
        F.transform(
            F.from_json(text, "array<variant>"),
            lambda v, i: F.struct(i.cast("string").alias("k"), F.to_json(v).alias("v")),
        ),
        lambda e: e.v.isNotNull() & (e.v != "null"),
    )
    keyed = F.transform_values(
        F.from_json(text, "map<string,variant>"), lambda _, v: F.to_json(v)
    )
    return F.coalesce(
        F.when(text.startswith("{"), keyed),
        F.when(text.startswith("["), F.map_from_entries(listed)),
        F.create_map().cast("map<string,string>"),
    )


def last_stint(stints: Column) -> Column:
    return F.try_element_at(stints, F.lit(-1))


def current_compound(stints: Column) -> Column:
    return F.coalesce(last_stint(stints)["compound"], F.lit("UNKNOWN"))


def tyre_age(stints: Column) -> Column:
    return F.coalesce(last_stint(stints)["total_laps"], F.lit(0)).cast("bigint")


def option_label(delay: Column, compound: Column) -> Column:
    when = F.when(delay == 0, "now").otherwise(F.concat(F.lit("lap +"), delay.cast("string")))
    return F.concat(when, F.lit(" on "), compound_short(compound))


def call_text(lap: Column, pit_lap: Column, code: Column) -> Column:
    when = F.when(pit_lap <= lap, "now").otherwise(F.concat(F.lit("lap "), pit_lap.cast("string")))
    return F.concat(F.lit("pit "), when, F.lit(" on "), code)


def format_skill(x: Column) -> Column:
    """Signed percentage with one decimal; a loss against a flawless baseline is ``worse*``.

    Rounds the stored binary value, half to even, as C and Python formatting do.
    Java's formatter rounds the shortest decimal spelling, half up, which differs
    in the last place. The fraction is therefore split into whole 2**-53 steps.
    """
    size = F.abs(F.when(F.abs(x) != F.lit(float("inf")), x) * 100)
    whole = F.floor(size)
    steps = ((size - whole) * float(1 << 53)).cast("bigint") * 10
    tenth = F.shiftright(steps, 53)
    rest = steps.bitwiseAND((1 << 53) - 1)
    half = F.lit(1 << 52)
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    tenths = whole * 10 + tenth + up.cast("bigint")
    sign = F.when(x < 0, "-").otherwise("+")
    shown = F.concat(
        sign,
        F.floor(tenths / 10).cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
        F.lit("%"),
    )
    return F.when(x == F.lit(float("-inf")), "worse*").otherwise(shown)
