"""Pace decomposition: driver + race lap + tyre age and offset per compound.

One least-squares fit per fit key, such as a session or a session as of a lap.
The design has one column per driver, so it is never built. Laps are summed per
(fit, driver, compound); drivers are partialled out of those sums; what is left
per fit is an 11 by 11 system however many laps or drivers there are. That
system, and nothing larger, is solved inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapstream.functions.text import compound_short
from lapstream.session import cut_lineage

# Limits of the fit.
MIN_LAPS = 30
MIN_STINTS = 2
PHASE_SEPARATION = 0.35
MAX_PACE_SPREAD = 10.0
MAX_DEGRADATION = 1.0

# Compounds with a degradation of their own, in column order.
FITTED = ("HARD", "INTERMEDIATE", "MEDIUM", "SOFT", "WET")
WIDTH = 1 + 2 * len(FITTED)
LAP, AGE, OFFSET = 0, 1, 1 + len(FITTED)
# Eigenvalues below this share of the largest are zero. The sums are of whole
# numbers and exact, so true zeros sit near 1e-15.
RANK_TOLERANCE = 1e-10

SUMS = ("n", "l", "ll", "a", "aa", "la", "y", "yy", "ly", "ay")


def usable_laps(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("lap_time").isNotNull() & (F.col("lap") >= 1))


def _known(compound: str = "compound") -> Column:
    return F.col(compound).isin(*FITTED)


def fit_groups(usable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fits worth making: at least 30 laps, and a known compound among them."""
    return (
        usable.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_laps"),
            F.max("lap").alias("max_lap"),
            F.sum(_known().cast("bigint")).alias("known_laps"),
        )
        .where((F.col("n_laps") >= MIN_LAPS) & (F.col("known_laps") > 0))
    )


def compound_usage(usable: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Laps per known compound, with its median lap; at most five rows per fit.

    The reference compound is the most used one, the first seen on a tie. Laps are
    counted per lap number first, so the exact median is read off a running count
    over lap numbers and never off the laps themselves.
    """
    return usage_of(lap_counts(usable, keys, order), keys)


def lap_counts(usable: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Laps of each known compound per lap number, and the first of them."""
    by = [*keys, "compound", "lap"]
    return usable.where(_known()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def usage_of(per_lap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`compound_usage` from counts per lap number."""
    by = [*keys, "compound"]
    along = Window.partitionBy(*by).orderBy("lap")
    whole = Window.partitionBy(*by)
    counted = per_lap.withColumns({"upto": F.sum("n").over(along), "laps": F.sum("n").over(whole)})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("lap")))

    used = counted.groupBy(*by, "laps").agg(
        F.min("first_seen").alias("first_seen"),
        (
            (at(F.floor((F.col("laps") - 1) / 2)) + at(F.floor(F.col("laps") / 2))) / 2
        ).alias("phase"),
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("laps"), "first_seen", "compound")
    return used.withColumn("is_reference", F.row_number().over(best) == 1)


def moments(usable: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Sums per (fit, driver, compound): everything the fit needs of the laps.

    Combined before the shuffle; a hot session shrinks to its drivers first.
    """
    lap, age, y = F.col("lap"), F.col("tyre_age"), F.col("lap_time")
    terms = {
        "n": F.lit(1), "l": lap, "ll": lap * lap, "a": age, "aa": age * age, "la": lap * age,
        "y": y, "yy": y * y, "ly": lap * y, "ay": age * y,
    }
    compound = F.when(_known(), F.col("compound")).otherwise("UNKNOWN")
    return usable.groupBy(*keys, "driver", compound.alias("compound"), *more).agg(
        *[F.sum(terms[s].cast("double")).alias(s) for s in SUMS], F.max("lap").alias("max_lap")
    )


def stint_sums(usable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same sums per stint as well."""
    return moments(usable, keys, ("stint",))


def design(usable: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-zero design entries per lap: driver, race lap, tyre age, offset.

    ``reference`` has the reference compound per fit, one row each.
    """
    known = _known()
    is_offset = known & (F.col("compound") != F.col("reference"))

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.cast("double").alias("value"))

    features = F.array_compact(
        F.array(
            entry(F.concat(F.lit("driver:"), F.col("driver").cast("string")), F.lit(1)),
            entry(F.lit("lap"), F.col("lap")),
            F.when(known, entry(F.concat(F.lit("age:"), F.col("compound")), F.col("tyre_age"))),
            F.when(is_offset, entry(F.concat(F.lit("offset:"), F.col("compound")), F.lit(1))),
        )
    )
    return usable.join(reference, list(keys)).withColumn("features", features)


def normal_equations(sums: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """XᵀX and Xᵀy by feature pair, spread out from the sums, not from laps.

    Feature ``y`` stands for the lap time, so (y, y) is yᵀy.
    """
    known = F.col("compound") != "UNKNOWN"
    offset = known & (F.col("compound") != F.col("reference"))
    names = {
        "driver": (F.concat(F.lit("driver:"), F.col("driver").cast("string")), F.lit(True)),
        "lap": (F.lit("lap"), F.lit(True)),
        "age": (F.concat(F.lit("age:"), F.col("compound")), known),
        "offset": (F.concat(F.lit("offset:"), F.col("compound")), offset),
        "y": (F.lit("y"), F.lit(True)),
    }
    product = {
        ("driver", "driver"): "n", ("driver", "lap"): "l", ("driver", "age"): "a",
        ("driver", "offset"): "n", ("driver", "y"): "y", ("lap", "lap"): "ll",
        ("lap", "age"): "la", ("lap", "offset"): "l", ("lap", "y"): "ly", ("age", "age"): "aa",
        ("age", "offset"): "a", ("age", "y"): "ay", ("offset", "offset"): "n",
        ("offset", "y"): "y", ("y", "y"): "yy",
    }
    cells = [
        F.when(
            names[i][1] & names[j][1],
            F.struct(names[i][0].alias("i"), names[j][0].alias("j"), F.col(s).alias("value")),
        )
        for (i, j), s in product.items()
    ]
    spread = sums.join(reference, list(keys)).select(
        *keys, F.inline(F.array_compact(F.array(*cells)))
    )
    return spread.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


def _driver_rows(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (fit, driver): sums over all laps and per fitted compound."""
    parts = [F.sum(s).alias(s) for s in ("n", "l", "y")]
    for c in FITTED:
        mine = F.col("compound") == c
        parts += [F.sum(F.when(mine, F.col(s)).otherwise(0.0)).alias(f"{s}_{c}") for s in ("n", "a")]
    return sums.groupBy(*keys, "driver").agg(*parts)


def _shared_means() -> list[Column]:
    """Driver means of the shared columns: lap, ages, offsets."""
    columns = ["l", *[f"a_{c}" for c in FITTED], *[f"n_{c}" for c in FITTED]]
    return [F.col(c) / F.col("n") for c in columns]


def systems(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per fit: total, within-driver and between-driver products, flattened.

    ``cross``/``cross_y`` are products over laps, ``mean``/``mean_y`` the same over
    driver means weighted by laps, ``plain``/``plain_y`` over driver means unweighted.
    """
    by_compound = sums.groupBy(*keys, "compound").agg(*[F.sum(s).alias(s) for s in SUMS])
    totals = by_compound.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in ("n", "l", "ll", "y", "yy", "ly")],
        F.collect_list(F.struct("compound", F.array(*SUMS).alias("sums"))).alias("parts"),
    )
    z = _shared_means()
    driver = _driver_rows(sums, keys).select(
        *keys, "n", F.array(*z).alias("z"), (F.col("y") / F.col("n")).alias("m")
    )
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]

    def zz(i: int, j: int) -> Column:
        return F.col("z")[i] * F.col("z")[j]

    means = driver.groupBy(*keys).agg(
        F.array(*[F.sum(zz(i, j) * F.col("n")) for i, j in pairs]).alias("mean"),
        F.array(*[F.sum(F.col("z")[i] * F.col("m") * F.col("n")) for i in range(WIDTH)]).alias(
            "mean_y"
        ),
        F.array(*[F.sum(zz(i, j)) for i, j in pairs]).alias("plain"),
        F.array(*[F.sum(F.col("z")[i] * F.col("m")) for i in range(WIDTH)]).alias("plain_y"),
        F.sum(F.col("m") * F.col("m") * F.col("n")).alias("mean_yy"),
        F.count(F.lit(1)).alias("n_drivers"),
    )
    return totals.join(means, list(keys))


RATES = T.MapType(T.StringType(), T.DoubleType())
SOLUTION = T.StructType(
    [
        T.StructField("trend", T.DoubleType()),
        T.StructField("degradation", RATES),
        T.StructField("offsets", RATES),
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("rank", T.LongType()),
        T.StructField("width", T.LongType()),
        T.StructField("ss_res", T.DoubleType()),
        T.StructField("ss_tot", T.DoubleType()),
        T.StructField("residual_std", T.DoubleType()),
        T.StructField("r_squared", T.DoubleType()),
    ]
)


def _square(flat: Sequence[float]) -> np.ndarray:
    out = np.zeros((WIDTH, WIDTH))
    rows, cols = np.triu_indices(WIDTH)
    out[rows, cols] = flat
    out[cols, rows] = flat
    return out


def solve_one(row) -> dict:
    """Solve one fit from its sums (an 11 by 11 system at most).

    Minimum norm over driver and shared coefficients together, as a dense
    least-squares solve of the full design gives for rank-deficient data.
    """
    parts = {p["compound"]: p["sums"] for p in row.parts}
    cross, cross_y = np.zeros((WIDTH, WIDTH)), np.zeros(WIDTH)
    cross[LAP, LAP], cross_y[LAP] = row.ll, row.ly
    used = []
    for i, c in enumerate(FITTED):
        if c not in parts:
            continue
        s = dict(zip(SUMS, parts[c], strict=True))
        a, o = AGE + i, OFFSET + i
        used.append(a)
        if c != row.reference:
            used.append(o)
        for (p, q), v in {
            (LAP, a): s["la"], (a, a): s["aa"], (a, o): s["a"], (o, o): s["n"], (LAP, o): s["l"],
        }.items():
            cross[p, q] = cross[q, p] = v
        cross_y[a], cross_y[o] = s["ay"], s["y"]
    keep = np.array([LAP, *sorted(used)])
    grid = np.ix_(keep, keep)
    within = (cross - _square(row.mean))[grid]
    within_y = (cross_y - np.asarray(row.mean_y))[keep]
    plain, plain_y = _square(row.plain)[grid], np.asarray(row.plain_y)[keep]

    scale = np.sqrt(np.maximum(np.diag(cross)[keep], 1.0))
    values, vectors = np.linalg.eigh(within / np.outer(scale, scale))
    live = values > RANK_TOLERANCE
    part = vectors[:, live]
    beta = (part @ ((part.T @ (within_y / scale)) / values[live])) / scale
    free = vectors[:, ~live] / scale[:, None]
    if free.shape[1]:
        # Any beta + free·t fits equally well; take the t of least total norm,
        # where a driver's own coefficient is its mean time less mean·beta.
        inner = free.T @ (plain + np.eye(len(keep))) @ free
        pull = free.T @ (plain_y - plain @ beta - beta)
        beta = beta + free @ np.linalg.solve(inner, pull)

    n, drivers = row.n, int(row.n_drivers)
    width = drivers + len(keep)
    within_yy = row.yy - row.mean_yy
    ss_res = max(0.0, within_yy - 2 * beta @ within_y + beta @ within @ beta)
    ss_tot = max(0.0, row.yy - row.y * row.y / n)
    freedom = n - min(width, n - 1)
    full = np.zeros(WIDTH)
    full[keep] = beta
    present = [(i, c) for i, c in enumerate(FITTED) if c in parts]
    return {
        "trend": float(full[LAP]),
        "degradation": {c: float(full[AGE + i]) for i, c in present},
        "offsets": {c: float(full[OFFSET + i]) for i, c in present},
        "beta": [float(b) for b in full],
        "rank": drivers + int(live.sum()),
        "width": width,
        "ss_res": float(ss_res),
        "ss_tot": float(ss_tot),
        "residual_std": float(np.sqrt(ss_res / freedom)),
        "r_squared": float(1 - ss_res / ss_tot) if ss_tot > 1e-12 * max(row.yy, 1.0) else 0.0,
    }


@F.pandas_udf(SOLUTION)
def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([solve_one(r) for r in rows.itertuples(index=False)])


NEEDED = (
    "n", "ll", "ly", "y", "yy", "parts", "reference", "mean", "mean_y", "plain", "plain_y",
    "mean_yy", "n_drivers",
)


def fit_pace(clean: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "seq") -> DataFrame:
    """One row per fit with coefficients, quality and warnings.

    Laps are read twice: for the counts per lap number behind the medians, and for sums
    per (driver, compound, stint). The sums are written out; all the rest comes from them.
    """
    keys = list(keys)
    usable = usable_laps(clean)
    return fit_sums(cut_lineage(stint_sums(usable, keys), "stint-sums"), lap_counts(usable, keys, order), keys)


def fit_sums(stints: DataFrame, per_lap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`fit_pace` from :func:`stint_sums`, read several times, and :func:`lap_counts`."""
    keys = list(keys)
    used = usage_of(per_lap, keys)
    marks = used.groupBy(*keys).agg(
        F.max(F.when(F.col("is_reference"), F.col("compound"))).alias("reference"),
        F.map_from_entries(F.collect_list(F.struct("compound", "phase"))).alias("phase"),
        (F.max("phase") - F.min("phase")).alias("phase_spread"),
        F.count(F.lit(1)).alias("n_compounds"),
    )
    groups = (
        stints.groupBy(*keys)
        .agg(
            F.sum("n").cast("bigint").alias("n_laps"),
            F.max("max_lap").alias("max_lap"),
            F.sum(F.when(_known(), F.col("n"))).alias("known_laps"),
            F.count_distinct(F.struct("driver", "stint")).alias("n_stints"),
        )
        .where((F.col("n_laps") >= MIN_LAPS) & (F.col("known_laps") > 0))
    )
    sums = stints.groupBy(*keys, "driver", "compound").agg(*[F.sum(s).alias(s) for s in SUMS])
    ready = groups.join(marks, keys).join(systems(sums, keys), keys)
    solved = ready.withColumn("fit", _solve(F.struct(*NEEDED)))
    spread = driver_pace(sums, solved.select(*keys, "fit.beta"), keys).groupBy(*keys).agg(
        (F.max("pace") - F.min("pace")).alias("pace_spread")
    )
    fitted = solved.select(
        *keys, "n_laps", "n_stints", "n_drivers", "reference", "phase", "phase_spread",
        "n_compounds", "max_lap", "fit.*",
    ).join(spread, keys)
    return fitted.withColumn("warnings", fit_warnings()).withColumn("refusals", refusals())


def driver_pace(sums: DataFrame, beta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each driver's own coefficient: mean time less the shared part at its means."""
    rows = _driver_rows(sums, keys).join(beta, list(keys))
    shared = sum((z * F.col("beta")[i] for i, z in enumerate(_shared_means())), F.lit(0.0))
    return rows.select(*keys, "driver", (F.col("y") / F.col("n") - shared).alias("pace"))


def _each_compound(values: Column, bad, text) -> Column:
    entries = F.filter(F.map_entries(values), lambda e: bad(e["value"]))
    return F.array_sort(
        F.transform(entries, lambda e: F.concat(compound_short(e["key"]), text(e["value"])))
    )


def phase_separated() -> Column:
    """Compounds run in different parts of the race cannot be told from its trend."""
    return (F.col("n_compounds") > 1) & (
        F.col("phase_spread") / F.col("max_lap") > PHASE_SEPARATION
    )


def fit_warnings() -> Column:
    single = [
        F.when(F.col("n_stints") < MIN_STINTS, F.lit("single stint: fuel and tyre wear not separable")),
        F.when(
            F.col("rank") < F.col("width"),
            F.concat(
                F.lit("rank deficient: "), F.col("rank").cast("string"), F.lit(" of "),
                F.col("width").cast("string"),
            ),
        ),
        F.when(F.col("trend") > 0, F.format_string("positive trend: %+.4f s/lap", F.col("trend"))),
        F.when(phase_separated(), F.lit("compounds separated by race phase")),
    ]
    negative = _each_compound(
        F.col("degradation"),
        lambda rate: rate < 0,
        lambda rate: F.format_string(" wear negative: %+.4f s/lap", rate),
    )
    return F.concat(F.array_compact(F.array(*single)), negative)


def refusals() -> Column:
    """Why a fit must not be used for a decision; empty when it may be."""
    single = [
        F.when(F.col("rank") < F.col("width"), F.lit("effects not identified")),
        F.when(F.col("trend") > 0, F.format_string("positive trend: %+.4f s/lap", F.col("trend"))),
        F.when(
            F.col("pace_spread") > MAX_PACE_SPREAD,
            F.format_string("driver spread %.1f s", F.col("pace_spread")),
        ),
    ]
    wild = _each_compound(
        F.col("degradation"),
        lambda rate: F.abs(rate) > MAX_DEGRADATION,
        lambda rate: F.format_string(" wear out of range: %+.2f s/lap", rate),
    )
    return F.concat(F.array_compact(F.array(*single)), wild)


def usable_fits(fits: DataFrame) -> DataFrame:
    return fits.where(F.size("refusals") == 0)


def refused_fits(fits: DataFrame) -> DataFrame:
    return fits.where(F.size("refusals") > 0)


def pace_table(clean: DataFrame, fits: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Driver pace rows for the given fits."""
    keys = list(keys)
    return driver_pace(moments(usable_laps(clean), keys), fits.select(*keys, "beta"), keys)


def coefficient_rows(fits: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Degradation and offset per compound, one row each; the reference has offset 0."""
    return fits.select(
        *keys, "trend", "reference", "offsets", F.explode("degradation").alias("compound", "degradation")
    ).select(
        *keys, "trend", "compound", "degradation",
        F.when(F.col("compound") == F.col("reference"), 0.0)
        .otherwise(F.element_at("offsets", F.col("compound")))
        .alias("offset"),
    )
