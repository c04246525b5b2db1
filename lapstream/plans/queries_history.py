"""Safety-car and retirement hazards, and building history (groups H, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.operators import hazard, history
from lapstream.plans import standins
from lapstream.plans.oracle_views import PHASE, RACE_LAPS, RACES
from lapstream.plans.registry import joined, query, r6
from lapstream.session import cut_lineage


def _statuses(spark, sf_dir):
    return history.lap_statuses(standins.observed(spark, sf_dir))


def _long(spark, sf_dir):
    """Races, starts and active laps of the stand-in history, in long form."""
    statuses = cut_lineage(_statuses(spark, sf_dir), "statuses")
    starts, active = [], []
    for flag in ("sc", "vsc"):
        on = history.laps_with(statuses, flag)
        active.append(on.withColumn("kind", F.lit(flag)))
        starts.append(history.period_starts(on).withColumn("kind", F.lit(flag)))
    return (
        standins.races(spark, sf_dir),
        starts[0].unionByName(starts[1]),
        active[0].unionByName(active[1]),
    )


def safety_counts(spark, sf_dir, kind="any"):
    return cut_lineage(hazard.neutralisation_counts(*_long(spark, sf_dir), kind), "counts")


def _gone(spark, sf_dir):
    return standins.observed(spark, sf_dir).where("retired").select("session_id", "driver", "lap")


def retire_counts(spark, sf_dir):
    races, gone = standins.races(spark, sf_dir), cut_lineage(_gone(spark, sf_dir), "gone")
    return cut_lineage(hazard.attrition_counts(races, gone), "counts")


def safety_curves(spark, sf_dir):
    return hazard.hazard_curves(safety_counts(spark, sf_dir), hazard.SAFETY_CAR_SHRINKAGE)


def retire_curves(spark, sf_dir):
    return hazard.hazard_curves(retire_counts(spark, sf_dir), hazard.ATTRITION_SHRINKAGE)


@query("h1_event_starts", f"WITH {RACES} SELECT session_id, lap FROM start")
def event_starts(spark, sf_dir):
    _, starts, active = _long(spark, sf_dir)
    return hazard.event_laps(starts, active, "any")[0]


@query(
    "h2_exposure",
    f"""WITH {RACE_LAPS} SELECT circuit, bucket, count(*) AS exposure,
      CAST(sum(event) AS BIGINT) AS events FROM risk GROUP BY circuit, bucket""",
)
def exposure(spark, sf_dir):
    return safety_counts(spark, sf_dir).where(F.col("exposure") > 0)


@query("h3_baseline", f"WITH {RACE_LAPS} SELECT bucket, round(hazard, 6) AS hazard FROM base")
def baseline(spark, sf_dir):
    return hazard.baseline(safety_counts(spark, sf_dir)).select("bucket", r6("hazard").alias("hazard"))


@query("h4_circuit_factor", f"WITH {RACE_LAPS} SELECT circuit, round(factor, 6) AS factor FROM factor")
def circuit_factor(spark, sf_dir):
    factors = hazard.circuit_factors(safety_counts(spark, sf_dir), hazard.SAFETY_CAR_SHRINKAGE)
    return factors.withColumn("factor", r6("factor"))


@query(
    "h5_circuit_races",
    f"WITH {RACES} SELECT circuit, count(*) AS races FROM race WHERE total_laps >= 2 GROUP BY circuit",
)
def circuit_races(spark, sf_dir):
    return hazard.circuit_races(standins.races(spark, sf_dir))


@query(
    "h6_hazard_summary",
    f"""WITH {RACE_LAPS}, thin AS (SELECT count(*) AS n FROM (SELECT circuit FROM race
        WHERE total_laps >= 2 GROUP BY circuit HAVING count(*) < 3))
    SELECT (SELECT count(*) FROM race) AS n_races, CAST(sum(event) AS BIGINT) AS n_events,
      count(*) AS exposure,
      concat_ws(',', CASE WHEN (SELECT n FROM thin) > 0
          THEN (SELECT n FROM thin) || ' circuits with under 3 races' END,
        CASE WHEN sum(event) < 20 THEN sum(event) || ' events: baseline is noisy' END) AS warnings
    FROM risk""",
)
def hazard_summary(spark, sf_dir):
    races, starts, active = _long(spark, sf_dir)
    counts = cut_lineage(
        hazard.neutralisation_counts(races, starts, active, "any"), "counts"
    )
    return hazard.hazard_summary(races, counts).withColumn("warnings", joined("warnings"))


@query(
    "h7_hazard_lookup",
    f"""WITH {RACE_LAPS}, asked AS (SELECT session_id, driver, lap, total_laps,
        CAST(CASE WHEN k = 0 THEN 77 ELSE circuit END AS VARCHAR) AS circuit FROM laps),
      placed AS (SELECT *, {PHASE} AS bucket FROM asked)
    SELECT session_id, driver, lap, f.circuit IS NOT NULL AS known_circuit,
      round(least(1.0, coalesce(hazard, 0) * coalesce(factor, 1)), 6) AS hazard
    FROM placed LEFT JOIN base USING (bucket) LEFT JOIN factor f USING (circuit)""",
)
def hazard_lookup(spark, sf_dir):
    asked = standins.laps(spark, sf_dir, stints=False).withColumn(
        "circuit", F.when(F.col("k") == 0, "77").otherwise(F.col("circuit").cast("string"))
    )
    found = hazard.with_curve(asked, safety_curves(spark, sf_dir))
    return found.select(
        "session_id",
        "driver",
        "lap",
        "known_circuit",
        r6(hazard.hazard_at(F.col("lap"), F.col("total_laps"))).alias("hazard"),
    )


@query(
    "h8_survival",
    f"""WITH {RACE_LAPS} SELECT session_id, round(product(1 - h), 6) AS survival,
      round(1 - product(1 - h), 6) AS probability
    FROM hlap WHERE lap BETWEEN greatest(1, total_laps // 3) AND total_laps // 3 + 8
    GROUP BY session_id""",
)
def survival(spark, sf_dir):
    """A window of laps in the first half of each race."""
    total = F.col("total_laps")
    third = F.floor(total / 3)
    first, last = F.greatest(F.lit(1), third), F.least(total, third + 8)
    asked = hazard.with_curve(
        standins.races(spark, sf_dir).where(F.col("total_laps") >= 2), safety_curves(spark, sf_dir)
    )
    return asked.select(
        "session_id",
        r6(hazard.survival(first, last, total)).alias("survival"),
        r6(hazard.probability_within(first, last, total)).alias("probability"),
    )


@query(
    "h9_expected_events",
    f"WITH {RACE_LAPS} SELECT session_id, round(sum(h), 6) AS expected FROM hlap GROUP BY 1",
)
def expected_events(spark, sf_dir):
    races = standins.races(spark, sf_dir).where(F.col("total_laps") >= 2)
    asked = hazard.with_curve(races, safety_curves(spark, sf_dir))
    return asked.select("session_id", r6(hazard.expected_events(F.col("total_laps"))).alias("expected"))


@query(
    "h10_circuit_query",
    f"""WITH {RACE_LAPS}, spans AS (SELECT unnest([5, 10, 15]) AS span),
      expect AS (SELECT session_id, total_laps, sum(h) AS expected FROM hlap GROUP BY 1, 2),
      ahead AS (SELECT session_id, total_laps, expected, span, greatest(1, total_laps // 2) + unnest(range(span)) AS lap
        FROM expect CROSS JOIN spans)
    SELECT a.session_id, CAST(span AS BIGINT) AS span, round(any_value(expected), 6) AS expected,
      round(1 - product(1 - h), 6) AS probability
    -- A window may go on past the flag, where every lap counts as the last.
    FROM ahead a JOIN hlap ON hlap.session_id = a.session_id AND hlap.lap = least(a.lap, a.total_laps)
    GROUP BY a.session_id, span""",
)
def circuit_query(spark, sf_dir):
    races = standins.races(spark, sf_dir).where(F.col("total_laps") >= 2)
    return hazard.mid_race_risk(races, safety_curves(spark, sf_dir)).select(
        "session_id", "span", r6("expected").alias("expected"), r6("probability").alias("probability")
    )


@query(
    "h11_forward_risk",
    f"""WITH {RACE_LAPS}, spans AS (SELECT unnest([5, 10, 20, NULL]) AS span)
    SELECT session_id, CAST(span AS BIGINT) AS span, round(1 - product(1 - h), 6) AS probability,
      round(1 - product(1 - ch), 6) AS retire_probability
    FROM hlap CROSS JOIN spans
    WHERE total_laps // 2 > 0 AND lap > total_laps // 2
      AND lap <= least(total_laps, total_laps // 2 + coalesce(span, total_laps))
    GROUP BY session_id, span""",
)
def forward_risk(spark, sf_dir):
    races = standins.races(spark, sf_dir).where(F.col("total_laps") >= 2)
    state = races.withColumn("lap", F.floor(F.col("total_laps") / 2))
    risk = hazard.forward_risk(state, safety_curves(spark, sf_dir), retire_curves(spark, sf_dir))
    return risk.select(
        "session_id",
        "span",
        r6("probability").alias("probability"),
        r6("retire_probability").alias("retire_probability"),
    )


@query(
    "i1_usable_retirements",
    f"""WITH {RACES} SELECT session_id, g.driver, least(g.lap, total_laps) AS stop FROM gone g
      JOIN race USING (session_id) WHERE starters > 0 AND total_laps >= 2 AND g.lap >= 1""",
)
def usable_retirements(spark, sf_dir):
    gone = _gone(spark, sf_dir)
    return hazard.usable_retirements(standins.races(spark, sf_dir), gone).select(
        "session_id", "driver", "stop"
    )


@query(
    "i2_car_exposure",
    f"""WITH {RACE_LAPS} SELECT circuit, bucket, count(*) AS exposure,
      CAST(sum(event) AS BIGINT) AS events FROM car GROUP BY circuit, bucket""",
)
def car_exposure(spark, sf_dir):
    return retire_counts(spark, sf_dir).where(F.col("exposure") > 0)


@query(
    "i3_baseline",
    f"WITH {RACE_LAPS} SELECT bucket, round(hazard, 6) AS hazard FROM cbase",
)
def attrition_baseline(spark, sf_dir):
    return hazard.baseline(retire_counts(spark, sf_dir)).select("bucket", r6("hazard").alias("hazard"))


@query(
    "i3_circuit_factor",
    f"WITH {RACE_LAPS} SELECT circuit, round(factor, 6) AS factor FROM cfactor",
)
def attrition_factor(spark, sf_dir):
    factors = hazard.circuit_factors(retire_counts(spark, sf_dir), hazard.ATTRITION_SHRINKAGE)
    return factors.withColumn("factor", r6("factor"))


@query(
    "i4_attrition_summary",
    f"""WITH {RACES}, use AS (SELECT * FROM race WHERE starters > 0 AND total_laps >= 2),
      thin AS (SELECT count(*) AS n FROM (SELECT circuit FROM use GROUP BY 1 HAVING count(*) < 3)),
      out AS (SELECT count(*) AS n FROM gone JOIN use USING (session_id))
    SELECT count(*) AS n_races, CAST(sum(starters) AS BIGINT) AS n_starters,
      (SELECT n FROM out) AS n_retirements,
      round((SELECT n FROM out) / CAST(sum(starters) AS DOUBLE), 6) AS rate_per_car,
      concat_ws(',', CASE WHEN (SELECT n FROM thin) > 0
          THEN (SELECT n FROM thin) || ' circuits with under 3 races' END,
        CASE WHEN (SELECT n FROM out) < 40
          THEN (SELECT n FROM out) || ' retirements: baseline is noisy' END) AS warnings
    FROM use""",
)
def attrition_summary(spark, sf_dir):
    found = hazard.attrition_summary(standins.races(spark, sf_dir), _gone(spark, sf_dir))
    return found.withColumns({"rate_per_car": r6("rate_per_car"), "warnings": joined("warnings")})


@query(
    "i5_retire_probability",
    f"""WITH {RACE_LAPS} SELECT session_id, round(product(1 - ch), 6) AS survival,
      round(1 - product(1 - ch), 6) AS probability FROM hlap GROUP BY session_id""",
)
def retire_probability(spark, sf_dir):
    total = F.col("total_laps")
    asked = hazard.with_curve(
        standins.races(spark, sf_dir).where(total >= 2), retire_curves(spark, sf_dir)
    )
    one = F.lit(1)
    return asked.select(
        "session_id",
        r6(hazard.survival(one, total, total)).alias("survival"),
        r6(hazard.probability_within(one, total, total)).alias("probability"),
    )


@query(
    "i6_expected_retirements",
    f"""WITH {RACE_LAPS} SELECT session_id, round(22 * (1 - product(1 - ch)), 6) AS expected
      FROM hlap GROUP BY session_id""",
)
def expected_retirements(spark, sf_dir):
    total = F.col("total_laps")
    asked = hazard.with_curve(
        standins.races(spark, sf_dir).where(total >= 2), retire_curves(spark, sf_dir)
    )
    field = 22 * hazard.probability_within(F.lit(1), total, total)
    return asked.select("session_id", r6(field).alias("expected"))


@query(
    "j1_lap_statuses",
    f"""WITH {RACES} SELECT session_id, lap, sc, vsc, FALSE AS red FROM flag""",
)
def lap_statuses(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query("j1_total_laps", f"WITH {RACES} SELECT session_id, total_laps FROM race")
def total_laps(spark, sf_dir):
    return history.race_totals(standins.observed(spark, sf_dir))


@query("j2_laps_with_status", f"WITH {RACES} SELECT session_id, lap FROM flag WHERE sc")
def laps_with_status(spark, sf_dir):
    return history.laps_with(_statuses(spark, sf_dir), "sc")


@query("j3_period_starts", f"WITH {RACES} SELECT session_id, lap FROM vsc_start")
def period_starts(spark, sf_dir):
    return history.period_starts(history.laps_with(_statuses(spark, sf_dir), "vsc"))


@query("j4_retirements", f"WITH {RACES} SELECT session_id, driver, lap FROM gone")
def retirements(spark, sf_dir):
    observed = standins.observed(spark, sf_dir)
    return history.retirements(standins.results(observed), observed)


def _history(spark, sf_dir):
    races = standins.races(spark, sf_dir).select("session_id", "circuit")
    observed = cut_lineage(standins.observed(spark, sf_dir), "observed")
    return history.race_history(observed, standins.results(observed), races)


LISTS = ("sc_laps", "vsc_laps", "sc_starts", "vsc_starts", "retirements")


def _sql_list(name: str, source: str) -> str:
    return (
        f"coalesce((SELECT string_agg(CAST(x.lap AS VARCHAR), ',' ORDER BY x.lap) FROM {source} x"
        f" WHERE x.session_id = r.session_id), '') AS {name}"
    )


HISTORY_SQL = ", ".join(
    _sql_list(n, s)
    for n, s in zip(
        LISTS,
        (
            "(SELECT * FROM flag WHERE sc)",
            "(SELECT * FROM flag WHERE vsc)",
            "sc_start",
            "vsc_start",
            "gone",
        ),
        strict=True,
    )
)


def _listed(record):
    return record.withColumns({n: F.array_join(n, ",") for n in LISTS}).drop(
        "red_laps", "red_starts"
    )


@query(
    "j5_race_history",
    f"WITH {RACES} SELECT session_id, circuit, total_laps, starters, {HISTORY_SQL} FROM race r",
)
def race_history(spark, sf_dir):
    return _listed(_history(spark, sf_dir))


@query(
    "j6_upsert_history",
    f"""WITH {RACES} SELECT session_id // 10 AS season, session_id % 10 AS round, total_laps,
      CASE WHEN session_id % 3 = 0 THEN 'collected' ELSE 'held' END AS origin FROM race""",
)
def upsert_history(spark, sf_dir):
    """Held records of an older shape (no starters) are collected again."""
    season, rnd = F.floor(F.col("session_id") / 10), F.col("session_id") % 10
    record = _history(spark, sf_dir).select(
        season.alias("season"), rnd.alias("round"), "total_laps", "starters", "retirements",
        (F.col("session_id") % 3 == 0).alias("old_shape"),
    )
    held = record.withColumns(
        {
            "starters": F.when(~F.col("old_shape"), F.col("starters")),
            "origin": F.lit("held"),
        }
    )
    merged = history.upsert_history(held, record.withColumn("origin", F.lit("collected")))
    return merged.select("season", "round", "total_laps", "origin")
