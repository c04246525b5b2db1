"""Discrete-time hazards per race phase, with a shrunk factor per circuit.

Safety cars and retirements are fitted the same way: events and laps at risk are
counted per (circuit, phase), a handful of rows however long the history is.
Laps at risk are counted by formula, not by making a row per lap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.functions.race import BUCKETS, phase_array, phase_laps, race_bucket
from lapstream.functions.text import normalise_circuit
from lapstream.session import cut_lineage

# Prior weights in expected events, and the sample sizes below
# which a fit carries a warning.
SAFETY_CAR_SHRINKAGE = 3.0
ATTRITION_SHRINKAGE = 4.0
MIN_EVENTS, MIN_RETIREMENTS, MIN_CIRCUIT_RACES = 20, 40, 3

# Look-ahead windows in laps.
MID_RACE_WINDOWS = (5, 10, 15)
FORWARD_WINDOWS = (5, 10, 20)

KINDS = {"sc": ("sc",), "vsc": ("vsc",), "any": ("sc", "vsc")}
ANY_CIRCUIT = "*"


def from_history(history: DataFrame, race: str = "race_id") -> dict[str, DataFrame]:
    """Long tables from array records: races, starts, active, retirements.

    Columns missing from the records count as absent data.
    """

    def laps_of(name: str) -> DataFrame:
        held = F.col(name) if name in history.columns else F.array()
        return history.select(race, F.explode(held.cast("array<bigint>")).alias("lap"))

    def both(part: str) -> DataFrame:
        kinds = [
            laps_of(f"{kind}_{part}").distinct().withColumn("kind", F.lit(kind))
            for kind in KINDS["any"]
        ]
        return kinds[0].unionByName(kinds[1])

    def plain(name: str) -> Column:
        held = F.col(name) if name in history.columns else F.lit(None)
        return held.cast("bigint").alias(name)

    return {
        "races": history.select(race, "circuit", plain("total_laps"), plain("starters")),
        "starts": both("starts"),
        "active": both("laps"),
        "retirements": laps_of("retirements"),
    }


def event_laps(
    starts: DataFrame, active: DataFrame, kind: str, race: str = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """Start laps and active laps of one kind of neutralisation.

    ``any`` joins both kinds; a start right after an active lap continues that
    period (a virtual safety car turned into a full one) and is no new event.
    """
    wanted = KINDS[kind]
    begun = starts.where(F.col("kind").isin(*wanted)).select(race, "lap").distinct()
    running = active.where(F.col("kind").isin(*wanted)).select(race, "lap").distinct()
    if kind == "any":
        followed = running.select(race, (F.col("lap") + 1).alias("lap"))
        begun = begun.join(followed, [race, "lap"], "left_anti")
    return begun, running


def _usable(races: DataFrame) -> DataFrame:
    return races.where(F.col("total_laps") >= 2).withColumn(
        "circuit", normalise_circuit(F.col("circuit"))
    )


def _by_phase(races: DataFrame, weight: Column) -> DataFrame:
    spread = phase_array(phase_laps(F.col("total_laps"), F.col("total_laps")))
    return races.select("circuit", weight.alias("_w"), F.inline(spread)).select(
        "circuit",
        "bucket",
        (F.col("laps") * F.col("_w")).alias("exposure"),
        F.lit(0).cast("bigint").alias("events"),
    )


def _total(parts: list[DataFrame]) -> DataFrame:
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy("circuit", "bucket").agg(
        F.sum("exposure").alias("exposure"), F.sum("events").alias("events")
    )


def neutralisation_counts(
    races: DataFrame, starts: DataFrame, active: DataFrame, kind: str, race: str = "session_id"
) -> DataFrame:
    """Laps at risk and events per (circuit, phase).

    A lap that is already neutralised is not at risk of a new start, so active
    laps that are no start are taken off the lap count of the race.
    """
    usable = _usable(races).select(race, "circuit", "total_laps")
    begun, running = event_laps(starts, active, kind, race)
    busy = running.join(begun, [race, "lap"], "left_anti")

    def placed(laps: DataFrame, exposure: int, events: int) -> DataFrame:
        inside = laps.join(usable, race).where(F.col("lap").between(1, F.col("total_laps")))
        return inside.select(
            "circuit",
            race_bucket(F.col("lap"), F.col("total_laps")).alias("bucket"),
            F.lit(exposure).cast("bigint").alias("exposure"),
            F.lit(events).cast("bigint").alias("events"),
        )

    whole = _by_phase(usable, F.lit(1).cast("bigint"))
    return _total([whole, placed(busy, -1, 0), placed(begun, 0, 1)])


def usable_attrition(races: DataFrame) -> DataFrame:
    return _usable(races).where(F.col("starters") > 0)


def usable_retirements(
    races: DataFrame, retirements: DataFrame, race: str = "session_id"
) -> DataFrame:
    """Retirements of usable races, with the stop lap kept within the distance."""
    return (
        retirements.where(F.col("lap") >= 1)
        .join(usable_attrition(races), race)
        .withColumn("stop", F.least("lap", "total_laps"))
    )


def attrition_counts(
    races: DataFrame, retirements: DataFrame, race: str = "session_id"
) -> DataFrame:
    """Car-laps at risk and retirements per (circuit, phase).

    Finishers are at risk over the whole distance, retired cars up to and
    including the lap they stop on.
    """
    usable = usable_attrition(races)
    gone = usable_retirements(races, retirements, race)
    n_gone = gone.groupBy(race).agg(F.count(F.lit(1)).alias("_gone"))
    finishers = F.greatest(
        F.lit(0), F.col("starters") - F.coalesce(F.col("_gone"), F.lit(0))
    ).cast("bigint")
    whole = _by_phase(usable.join(n_gone, race, "left"), finishers)
    until = phase_array(phase_laps(F.col("total_laps"), F.col("stop")))
    partial = gone.select(
        "circuit",
        race_bucket(F.col("stop"), F.col("total_laps")).alias("_stopped_in"),
        F.inline(until),
    ).select(
        "circuit",
        "bucket",
        F.col("laps").alias("exposure"),
        (F.col("bucket") == F.col("_stopped_in")).cast("bigint").alias("events"),
    )
    return _total([whole, partial])


def baseline(counts: DataFrame) -> DataFrame:
    """Hazard per phase: at most five rows."""
    return (
        counts.groupBy("bucket")
        .agg(F.sum("exposure").alias("exposure"), F.sum("events").alias("events"))
        .where(F.col("exposure") > 0)
        .withColumn("hazard", F.col("events") / F.col("exposure"))
    )


def circuit_factors(counts: DataFrame, shrinkage: float) -> DataFrame:
    """Observed over expected events per circuit, pulled towards one.

    The baseline is broadcast: one row per phase, five at most by construction.
    """
    at_risk = counts.where(F.col("exposure") > 0)
    expected = at_risk.join(F.broadcast(baseline(counts).select("bucket", "hazard")), "bucket")
    return expected.groupBy("circuit").agg(
        (
            (F.sum("events") + shrinkage)
            / (F.sum(F.col("hazard") * F.col("exposure")) + shrinkage)
        ).alias("factor")
    )


def circuit_races(races: DataFrame) -> DataFrame:
    return _usable(races).groupBy("circuit").agg(F.count(F.lit(1)).alias("races"))


def _warnings(events: Column, least: int, what: str, thin: Column) -> Column:
    few = F.when(
        events < least, F.concat(events.cast("string"), F.lit(f" {what}: baseline is noisy"))
    )
    poor = F.when(
        thin > 0,
        F.concat(thin.cast("string"), F.lit(f" circuits with under {MIN_CIRCUIT_RACES} races")),
    )
    return F.array_compact(F.array(few, poor))


def _thin(races: DataFrame) -> Column:
    """Number of circuits with too few races, as a scalar subquery."""
    thin = F.sum((F.col("races") < MIN_CIRCUIT_RACES).cast("bigint"))
    return circuit_races(races).agg(F.coalesce(thin, F.lit(0))).scalar()


def hazard_summary(races: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for the safety-car fit; no row where no lap was at risk."""
    totals = counts.agg(F.sum("exposure").alias("exposure"), F.sum("events").alias("n_events"))
    return totals.where(F.col("exposure") > 0).select(
        races.agg(F.count(F.lit(1))).scalar().alias("n_races"),
        "n_events",
        "exposure",
        _warnings(F.col("n_events"), MIN_EVENTS, "events", _thin(races)).alias("warnings"),
    )


def attrition_summary(
    races: DataFrame, retirements: DataFrame, race: str = "session_id"
) -> DataFrame:
    """One row for the retirement fit; no row where no race is usable."""
    usable = usable_attrition(races)
    gone = usable_retirements(races, retirements, race).agg(F.count(F.lit(1))).scalar()
    totals = usable.agg(
        F.count(F.lit(1)).alias("n_races"), F.sum("starters").alias("n_starters")
    ).where(F.col("n_races") > 0)
    counted = totals.withColumns({"n_retirements": gone, "thin": _thin(usable)})
    return counted.select(
        "n_races",
        "n_starters",
        "n_retirements",
        (F.col("n_retirements") / F.col("n_starters")).alias("rate_per_car"),
        _warnings(
            F.col("n_retirements"), MIN_RETIREMENTS, "retirements", F.col("thin")
        ).alias("warnings"),
    )


def hazard_curves(counts: DataFrame, shrinkage: float) -> DataFrame:
    """``(circuit, factor, curve MAP<phase, hazard>)``, with a row ``*`` of factor one.

    Five map entries per circuit, so a window probability becomes one expression
    over a query row, with no lap-by-lap expansion.
    """
    phases = baseline(counts).select("bucket", "hazard")
    pairs = F.collect_list(F.struct("bucket", "hazard"))
    base = phases.agg(F.map_from_entries(pairs)).scalar()
    plain = phases.select(F.lit(ANY_CIRCUIT).alias("circuit"), F.lit(1.0).alias("factor"))
    factors = circuit_factors(counts, shrinkage).unionByName(plain.distinct())
    curves = factors.withColumn("base", base).select(
        "circuit",
        "factor",
        F.transform_values(
            "base", lambda _, h: F.least(F.lit(1.0), h * F.col("factor"))
        ).alias("curve"),
    )
    # A fitted model: one row per circuit, looked up twice by every question.
    return cut_lineage(curves, "curves")


def with_curve(asked: DataFrame, curves: DataFrame) -> DataFrame:
    """Attach each row's curve by circuit; unknown circuits get the plain baseline."""
    own = curves.where(F.col("circuit") != ANY_CIRCUIT).select(
        "circuit", F.col("curve").alias("_own"), F.col("factor").alias("_factor")
    )
    plain = curves.where(F.col("circuit") == ANY_CIRCUIT).select("curve").scalar()
    named = asked.withColumn("circuit", normalise_circuit(F.col("circuit")))
    return (
        named.join(own, "circuit", "left")
        .withColumns(
            {
                "curve": F.coalesce("_own", plain),
                "known_circuit": F.col("_own").isNotNull(),
                "circuit_factor": F.coalesce("_factor", F.lit(1.0)),
            }
        )
        .drop("_own", "_factor")
    )


def _phase_hazard(curve: Column, bucket: Column | str) -> Column:
    key = F.lit(bucket) if isinstance(bucket, str) else bucket
    return F.coalesce(F.try_element_at(curve, key), F.lit(0.0))


def hazard_at(lap: Column, total_laps: Column, curve: Column | None = None) -> Column:
    curve = F.col("curve") if curve is None else curve
    return _phase_hazard(curve, race_bucket(lap, total_laps))


def survival(
    first: Column, last: Column, total_laps: Column, curve: Column | None = None
) -> Column:
    """No event on any lap of ``first..last``: a power per phase, multiplied."""
    curve = F.col("curve") if curve is None else curve
    held = phase_laps(total_laps, last, first)
    powers = [F.pow(1 - _phase_hazard(curve, b), held[b]) for b in BUCKETS]
    return reduce(lambda a, b: a * b, powers)


def probability_within(
    first: Column, last: Column, total_laps: Column, curve: Column | None = None
) -> Column:
    return 1 - survival(first, last, total_laps, curve)


def expected_events(total_laps: Column, curve: Column | None = None) -> Column:
    curve = F.col("curve") if curve is None else curve
    held = phase_laps(total_laps, total_laps)
    return reduce(lambda a, b: a + b, [_phase_hazard(curve, b) * held[b] for b in BUCKETS])


def _spans(spans: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.lit(s).cast("bigint") for s in spans]))


def mid_race_risk(asked: DataFrame, curves: DataFrame) -> DataFrame:
    """Probability over the windows that open at half distance, per asked circuit."""
    total = F.col("total_laps")
    start = F.greatest(F.lit(1), F.floor(total / 2))
    spread = with_curve(asked, curves).withColumn("span", _spans(MID_RACE_WINDOWS))
    return spread.withColumns(
        {
            "expected": expected_events(total),
            "from_lap": start,
            "to_lap": start + F.col("span") - 1,
            "probability": probability_within(start, start + F.col("span") - 1, total),
        }
    )


def forward_risk(state: DataFrame, safety: DataFrame, attrition: DataFrame | None = None) -> DataFrame:
    """Probability over the next laps and to the flag, from the current lap.

    Windows stop at the flag; one that would be empty is left out. ``span`` NULL
    is the rest of the race. With attrition curves, the chance that one given car
    retires over the same laps comes along.
    """
    lap, total = F.col("lap"), F.col("total_laps")
    spans = F.array(*[F.lit(s).cast("bigint") for s in FORWARD_WINDOWS], F.lit(None).cast("bigint"))
    end = F.least(total, lap + F.coalesce(F.col("span"), total))
    running = state.where((total > 0) & (lap > 0))
    risk = with_curve(running, safety).withColumns({"span": F.explode(spans)})
    risk = risk.where(F.col("span").isNull() | (end > lap)).withColumn(
        "probability", probability_within(lap + 1, end, total)
    )
    if attrition is None:
        return risk.drop("curve")
    kept = risk.drop("curve").withColumnsRenamed(
        {"known_circuit": "known", "circuit_factor": "factor"}
    )
    both = with_curve(kept, attrition).withColumn(
        "retire_probability", probability_within(lap + 1, end, total)
    )
    return both.drop("curve", "known_circuit", "circuit_factor").withColumnsRenamed(
        {"known": "known_circuit", "factor": "circuit_factor"}
    )
