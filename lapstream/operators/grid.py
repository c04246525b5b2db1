"""Grid and option tables built from the running order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.functions.text import (
    RACING_COMPOUNDS,
    interval_seconds,
    laps_down,
    option_label,
)
from lapstream.operators.fold import UNPLACED, order_columns
from lapstream.operators.scan import ranked
from lapstream.session import cut_lineage

# Spacing in seconds where a gap says nothing, and per lap down.
LAPPED_PENALTY = 40.0
UNKNOWN_GAP = 1.5
LADDER_GAP = 0.6
# Candidate stops and the reach of an undercut in seconds.
DELAYS = (0, 3, 6, 10)
UNDERCUT_WINDOW = 4.0

CHUNK_CARS = 512


def _order_chunk() -> Column:
    """Coarse running order: never falls along ``order_columns``, and splits big fields."""
    place = F.when(F.col("position") == 0, UNPLACED).otherwise(F.col("position"))
    unplaced = F.col("position").isNull()
    return F.struct(
        unplaced.alias("unplaced"),
        F.coalesce(F.floor(place / CHUNK_CARS), F.lit(0)).alias("block"),
        F.when(unplaced, F.floor(F.col("first_seen") / (1 << 20))).alias("late"),
    )


def with_place(cars: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Add ``place``: 1 for the leader, counting down the running order."""
    return ranked(cars, list(keys), order_columns(), _order_chunk(), "place")


def _gap_rule() -> Column:
    """How a car's time follows from the time ``x`` of the car ahead of it.

    Every rule has the form ``x <= limit ? value : x + step``:
    a lapped car is always ``x + step``; a car with a gap takes the gap unless the
    car ahead is already beyond it; a car without one follows at a fixed spacing.
    Rules of this form compose to a rule of the same form.
    """
    gap, down = interval_seconds(F.col("gap_to_leader")), laps_down(F.col("gap_to_leader"))
    never, nothing = F.lit(float("-inf")), F.lit(0.0)
    first = F.struct(
        F.lit(float("inf")).alias("limit"), nothing.alias("value"), nothing.alias("step")
    )
    lapped = F.struct(
        never.alias("limit"), nothing.alias("value"), (down * LAPPED_PENALTY).alias("step")
    )
    placed = F.struct(
        F.coalesce(gap, never).alias("limit"),
        F.coalesce(gap, nothing).alias("value"),
        F.lit(UNKNOWN_GAP).alias("step"),
    )
    return F.when(F.col("place") == 1, first).when(down > 0, lapped).otherwise(placed)


def _apply(rule: Column, x: Column) -> Column:
    return F.when(x <= rule["limit"], rule["value"]).otherwise(x + rule["step"])


def _compose(first: Column, then: Column) -> Column:
    """One rule for applying ``first`` and then ``then``.

    Up to first.limit the result is a constant; beyond it the time is shifted and
    meets the second limit later, so the limits merge into the larger of the two.
    """
    moved = then["limit"] - first["step"]
    reaches = moved > first["limit"]
    return F.struct(
        F.greatest(first["limit"], moved).alias("limit"),
        F.when(reaches, then["value"]).otherwise(_apply(then, first["value"])).alias("value"),
        (first["step"] + then["step"]).alias("step"),
    )


def _fold(entries: Column, start: Column, step, finish=None) -> Column:
    return F.aggregate(entries, start, step, finish) if finish else F.aggregate(entries, start, step)


def ordered_gaps(cars: DataFrame, keys: Sequence[str] = ("session_id",), chunk: int = CHUNK_CARS) -> DataFrame:
    """Elapsed time of each car behind the leader, never falling down the order.

    Needs ``place`` (see :func:`with_place`). Each time depends on the car ahead,
    so this is an ordered fold. It runs over chunks of the order: a chunk's rules
    are composed into one, the composed rules are folded along the session, and
    each chunk is then walked from the time it starts with.
    """
    keys = list(keys)
    ruled = cars.select(*keys, "car", "place", _gap_rule().alias("rule")).withColumn(
        "chunk", F.floor((F.col("place") - 1) / chunk)
    )
    entry = F.struct("place", "car", "rule")
    blocks = ruled.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(entry)).alias("cars"))
    same = F.struct(
        F.lit(float("-inf")).alias("limit"), F.lit(0.0).alias("value"), F.lit(0.0).alias("step")
    )
    composed = _fold(F.col("cars"), same, lambda acc, c: _compose(acc, c["rule"]))
    # Read twice below: once to chain the chunks, once to walk them.
    blocks = cut_lineage(blocks.withColumn("rule", composed), "blocks")
    # One composed rule per chunk: short even for a very large field.
    chain = blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "rule"))).alias("chain")
    )
    starts = chain.select(
        *keys,
        F.inline(
            _fold(
                F.col("chain"),
                F.struct(
                    F.lit(0.0).alias("x"),
                    F.array().cast("array<struct<chunk:bigint,start:double>>").alias("out"),
                ),
                lambda acc, b: F.struct(
                    _apply(b["rule"], acc["x"]).alias("x"),
                    F.concat(
                        acc["out"],
                        F.array(F.struct(b["chunk"].alias("chunk"), acc["x"].alias("start"))),
                    ).alias("out"),
                ),
                lambda acc: acc["out"],
            )
        ),
    )
    walked = blocks.join(starts, [*keys, "chunk"]).select(
        *keys,
        F.inline(
            _fold(
                F.col("cars"),
                F.struct(
                    F.col("start").alias("x"),
                    F.array().cast("array<struct<car:string,place:bigint,elapsed:double>>").alias("out"),
                ),
                lambda acc, c: _walk(acc, c),
                lambda acc: acc["out"],
            )
        ),
    )
    return walked


def _walk(acc: Column, car: Column) -> Column:
    x = _apply(car["rule"], acc["x"])
    row = F.struct(
        car["car"].alias("car"), car["place"].cast("bigint").alias("place"), x.alias("elapsed")
    )
    return F.struct(x.alias("x"), F.concat(acc["out"], F.array(row)).alias("out"))


def grid_entries(cars: DataFrame, pace: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Cars with elapsed time, fitted pace (0 where unknown), tyre, age and stops."""
    keys = list(keys)
    timed = ordered_gaps(cars, keys).join(cars.drop("place"), [*keys, "car"])
    known = pace.select(*keys, F.col("driver").cast("string").alias("car"), "pace")
    return timed.join(known, [*keys, "car"], "left").select(
        *keys,
        "car",
        F.coalesce(F.nullif("tla", F.lit("")), F.col("car")).alias("tla"),
        F.coalesce("pace", F.lit(0.0)).alias("base_pace"),
        "compound",
        "tyre_age",
        F.col("pit_count").alias("stops"),
        "place",
        "elapsed",
    )


def pace_ladder(pace: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """A start grid from fitted pace alone: quickest first, evenly spaced.

    Cars whose pace is not known start at the back.
    """
    unknown = F.col("pace").isNull()
    chunk = F.struct(unknown.alias("unknown"), F.floor(F.col("pace") * 10).alias("band"))
    order = [unknown, F.col("pace"), F.col("driver")]
    placed = ranked(pace, list(keys), order, chunk, "place")
    return placed.withColumn("elapsed", (F.col("place") - 1) * LADDER_GAP)


def current_position(
    entries: DataFrame, keys: Sequence[str] = ("session_id",), tie: str = "place"
) -> DataFrame:
    """Rank by elapsed time; cars level on time keep their order of entry."""
    return ranked(
        entries,
        list(keys),
        [F.col("elapsed"), F.col(tie)],
        F.floor(F.col("elapsed") / 60),
        "current_position",
    )


def candidate_options(
    state: DataFrame,
    delays: tuple[int, ...] = DELAYS,
    compounds: tuple[str, ...] = RACING_COMPOUNDS,
) -> DataFrame:
    """Every (delay, compound) stop for each row; the stop lap stays within the race."""
    choices = [
        F.struct(F.lit(d).cast("bigint").alias("delay"), F.lit(c).alias("option_compound"))
        for d in delays
        for c in compounds
    ]
    spread = state.select("*", F.posexplode(F.array(*choices)).alias("option_id", "_o"))
    return spread.select(
        *state.columns,
        F.col("option_id").cast("bigint").alias("option_id"),
        "_o.*",
        F.least(F.col("lap") + F.col("_o.delay"), F.col("total_laps")).alias("pit_lap"),
        option_label(F.col("_o.delay"), F.col("_o.option_compound")).alias("label"),
    )


def threat_candidates(
    entries: DataFrame,
    subjects: DataFrame,
    keys: Sequence[str] = ("session_id",),
    window: float = UNDERCUT_WINDOW,
) -> DataFrame:
    """Cars behind the subject by no more than the window.

    Each session has one subject, so the equi-join on the session gives at most
    one row per car; the gap is a filter on top.
    """
    ours = subjects.select(*keys, F.col("car").alias("subject"), F.col("elapsed").alias("_ours"))
    return (
        entries.join(ours, list(keys))
        .withColumn("gap", F.col("elapsed") - F.col("_ours"))
        .where((F.col("car") != F.col("subject")) & (F.col("gap") > 0) & (F.col("gap") <= window))
        .drop("_ours")
    )


def subject_car(entries: DataFrame, wanted: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The car asked for by code or number in each session, else the leader."""
    code = wanted.strip().upper()
    named = (F.upper("tla") == code) | (F.col("car") == wanted) if code else F.lit(False)
    first = Window.partitionBy(*keys).orderBy(F.desc("_named"), "place")
    return (
        entries.withColumn("_named", named.cast("int"))
        .withColumn("_pick", F.row_number().over(first))
        .where("_pick = 1")
        .drop("_named", "_pick")
    )
