"""Arithmetic over (lap, total_laps): race phase, progress and fuel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Race phases and the share of the race at which each one ends.
BUCKETS = ("lap1", "early", "mid", "late", "final")
PHASE_ENDS = (0.25, 0.50, 0.75)

# Fuel allowance in kg and seconds lost per kg carried.
START_FUEL_KG = 70.0
SECONDS_PER_KG = 0.035


def race_bucket(lap: Column, total_laps: Column) -> Column:
    """Phase of the race a lap falls in. Lap 1, the standing start, stands alone."""
    done = (lap - 1) / F.greatest(F.lit(1), total_laps - 1)
    early, mid, late = PHASE_ENDS
    return (
        F.when(lap <= 1, "lap1")
        .when((total_laps <= 1) | (done < early), "early")
        .when(done < mid, "mid")
        .when(done < late, "late")
        .otherwise("final")
    )


def phase_laps(total_laps: Column, last: Column, first: Column | int = 1) -> dict[str, Column]:
    """How many of the laps ``first..last`` each race phase holds.

    Counting by formula keeps one row per race where a lap-by-lap expansion would
    make one per lap. A phase that ends at share f holds the laps with
    ``lap - 1 < f * (total - 1)``; f is a multiple of 1/4, so the product is exact.
    Laps past the distance belong to the last phase.
    """
    span = F.greatest(F.lit(1), total_laps - 1).cast("double")
    none = F.lit(0).cast("bigint")
    last, first = last.cast("bigint"), F.greatest(F.lit(1), F.lit(first)).cast("bigint")
    short = total_laps <= 1
    ends = [F.lit(1).cast("bigint")]
    for i, share in enumerate(PHASE_ENDS):
        end = F.greatest(F.lit(1).cast("bigint"), F.ceil(span * share))
        # a race of one lap has nothing but an opening lap and an early phase
        ends.append(F.when(short, F.greatest(last, F.lit(1))).otherwise(end) if i == 0 else end)
    ends.append(F.greatest(last, ends[-1]))
    counts, start = {}, none
    for name, end in zip(BUCKETS, ends, strict=True):
        inside = F.least(end, last) - F.greatest(start, first - 1)
        counts[name] = F.greatest(none, inside)
        start = F.greatest(start, end)
    return counts


def phase_array(counts: dict[str, Column]) -> Column:
    """The same counts as ``array<struct<bucket,laps>>``, five entries, to explode."""
    return F.array(
        *[F.struct(F.lit(b).alias("bucket"), n.alias("laps")) for b, n in counts.items()]
    )


def laps_remaining(lap: Column, total_laps: Column) -> Column:
    return F.greatest(F.lit(0), total_laps - lap)


def progress(lap: Column, total_laps: Column) -> Column:
    return F.coalesce(F.round(lap / F.nullif(total_laps, F.lit(0)), 4), F.lit(0.0))


def burn_per_lap(total_laps: Column, start_kg: float = START_FUEL_KG) -> Column:
    """Fuel used per lap; NULL where the race length is not positive."""
    return F.when(total_laps > 0, F.lit(start_kg) / total_laps)


def seconds_per_lap(
    total_laps: Column, start_kg: float = START_FUEL_KG, per_kg: Column | float = SECONDS_PER_KG
) -> Column:
    return burn_per_lap(total_laps, start_kg) * per_kg


def fuel_during_lap(lap: Column, total_laps: Column, start_kg: float = START_FUEL_KG) -> Column:
    """Mean fuel aboard during the lap: taken at mid-lap, never below zero."""
    left = F.lit(start_kg) - burn_per_lap(total_laps, start_kg) * (lap - 0.5)
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), left))


def fuel_penalty(
    lap: Column,
    total_laps: Column,
    start_kg: float = START_FUEL_KG,
    per_kg: Column | float = SECONDS_PER_KG,
) -> Column:
    return fuel_during_lap(lap, total_laps, start_kg) * per_kg


def fuel_corrected(
    lap_time: Column,
    lap: Column,
    total_laps: Column,
    start_kg: float = START_FUEL_KG,
    per_kg: Column | float = SECONDS_PER_KG,
) -> Column:
    """Lap time as if the tank had been empty."""
    return lap_time - fuel_penalty(lap, total_laps, start_kg, per_kg)


def calibrated_seconds_per_kg(
    trend: Column, total_laps: Column, start_kg: float = START_FUEL_KG
) -> Column:
    """Fuel sensitivity from a measured per-lap trend, whatever its sign."""
    return F.abs(trend) / burn_per_lap(total_laps, start_kg)


def implied_seconds_per_kg(trend: Column, burn: Column) -> Column:
    """Same check for a given burn; NaN where nothing is burnt."""
    return F.when(burn > 0, F.abs(trend) / burn).otherwise(F.lit(float("nan")))
