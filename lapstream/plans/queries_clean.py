"""Clean-lap rules and fuel correction (inventory groups E and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.functions import race
from lapstream.operators import clean
from lapstream.plans import standins
from lapstream.plans.oracle_views import LAPS
from lapstream.plans.registry import joined, query, r6

BEST = (
    LAPS
    + """,
best AS (
  SELECT session_id, min(CASE WHEN status NOT IN ('4', '5', '6') AND NOT entered_pit
    AND NOT exited_pit AND lap_time > 0 THEN lap_time END) AS best
  FROM laps GROUP BY session_id),
flags AS (
  SELECT l.*, best,
    lap_time IS NULL AS no_time, lap = 1 AS first_lap, entered_pit AS in_lap,
    exited_pit OR (stint > 0 AND tyre_age = 0) AS out_lap,
    status IN ('4', '5', '6') AS neutralised,
    coalesce(gap_s < 2, FALSE) AS traffic,
    coalesce(lap_time > best * CAST(1.4 AS DOUBLE), FALSE) AS implausible
  FROM laps l LEFT JOIN best USING (session_id)),
clean AS (
  SELECT * FROM flags WHERE NOT (no_time OR first_lap OR in_lap OR out_lap OR neutralised
    OR retired OR traffic OR implausible)),
reasons AS (
  SELECT session_id, driver, lap, 'NO_TIME' AS reason FROM flags WHERE no_time
  UNION ALL SELECT session_id, driver, lap, 'FIRST_LAP' FROM flags WHERE first_lap
  UNION ALL SELECT session_id, driver, lap, 'IN_LAP' FROM flags WHERE in_lap
  UNION ALL SELECT session_id, driver, lap, 'OUT_LAP' FROM flags WHERE out_lap
  UNION ALL SELECT session_id, driver, lap, 'NEUTRALISED' FROM flags WHERE neutralised
  UNION ALL SELECT session_id, driver, lap, 'RETIRED' FROM flags WHERE retired
  UNION ALL SELECT session_id, driver, lap, 'TRAFFIC' FROM flags WHERE traffic
  UNION ALL SELECT session_id, driver, lap, 'IMPLAUSIBLE' FROM flags WHERE implausible)"""
)


def classified(spark, sf_dir):
    return clean.classify_laps(standins.laps(spark, sf_dir))


def _one_reason(name: str, flag: str):
    @query(
        name,
        f"WITH {BEST} SELECT session_id, driver, lap FROM flags WHERE {flag.lower()}",
    )
    def run(spark, sf_dir):
        found = classified(spark, sf_dir).where(F.array_contains("reasons", flag))
        return found.select("session_id", "driver", "lap")

    return run


@query(
    "e1_session_best",
    f"WITH {BEST} SELECT session_id, round(best, 6) AS best FROM best",
)
def session_best(spark, sf_dir):
    return clean.session_best(standins.laps(spark, sf_dir)).select("session_id", r6("best").alias("best"))


for _id, _flag in (
    ("e2_no_time", "NO_TIME"),
    ("e3_first_lap", "FIRST_LAP"),
    ("e4_in_lap", "IN_LAP"),
    ("e5_out_lap", "OUT_LAP"),
    ("e6_neutralised", "NEUTRALISED"),
    ("e7_retired", "RETIRED"),
    ("e8_traffic", "TRAFFIC"),
    ("e9_implausible", "IMPLAUSIBLE"),
):
    _one_reason(_id, _flag)


@query(
    "e10_classify_laps",
    f"""WITH {BEST} SELECT f.session_id, f.driver, f.lap, coalesce(r.reasons, '') AS reasons
    FROM flags f LEFT JOIN (SELECT session_id, driver, lap, string_agg(reason, ',' ORDER BY reason)
      AS reasons FROM reasons GROUP BY session_id, driver, lap) r
    USING (session_id, driver, lap)""",
)
def classify_laps(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "session_id", "driver", "lap", joined("reasons").alias("reasons")
    )


@query(
    "e11_filter_laps",
    f"""WITH {BEST} SELECT session_id, driver, lap, round(lap_time, 6) AS lap_time, compound,
      tyre_age FROM clean""",
)
def filter_laps(spark, sf_dir):
    return clean.clean_laps(classified(spark, sf_dir)).select(
        "session_id", "driver", "lap", r6("lap_time").alias("lap_time"), "compound", "tyre_age"
    )


@query(
    "e11_rejected_laps",
    f"WITH {BEST} SELECT DISTINCT session_id, driver, lap FROM reasons",
)
def rejected_laps(spark, sf_dir):
    return clean.rejected_laps(classified(spark, sf_dir)).select("session_id", "driver", "lap")


@query(
    "e12_filter_totals",
    f"""WITH {BEST} SELECT session_id, count(*) AS total, count(c.lap) AS clean,
      count(*) - count(c.lap) AS excluded,
      round(count(c.lap) / CAST(count(*) AS DOUBLE), 6) AS clean_fraction
    FROM flags f LEFT JOIN clean c USING (session_id, driver, lap) GROUP BY session_id""",
)
def filter_totals(spark, sf_dir):
    totals = clean.filter_totals(classified(spark, sf_dir))
    return totals.withColumn("clean_fraction", r6("clean_fraction"))


@query(
    "e12_filter_report",
    f"WITH {BEST} SELECT session_id, reason, count(*) AS laps FROM reasons GROUP BY 1, 2",
)
def filter_report(spark, sf_dir):
    return clean.reason_counts(classified(spark, sf_dir))


@query(
    "e13_clean_by_compound",
    f"""WITH {BEST} SELECT session_id, CASE compound WHEN 'SOFT' THEN 'SOF' WHEN 'MEDIUM' THEN 'MED'
      WHEN 'HARD' THEN 'HAR' ELSE '---' END AS code, count(*) AS laps, min(tyre_age) AS min_age,
      max(tyre_age) AS max_age, round(min(lap_time), 6) AS fastest
    FROM clean GROUP BY 1, 2""",
)
def clean_by_compound(spark, sf_dir):
    found = clean.by_compound(clean.clean_laps(classified(spark, sf_dir)))
    return found.withColumn("fastest", r6("fastest"))


@query(
    "f1_fuel_burn",
    f"""WITH {LAPS} SELECT session_id, round(70.0 / CAST(max(total_laps) AS DOUBLE), 6) AS burn_kg,
      round(70.0 / CAST(max(total_laps) AS DOUBLE) * 0.035, 6) AS sec_per_lap
    FROM laps GROUP BY session_id""",
)
def fuel_burn(spark, sf_dir):
    total = F.col("total_laps")
    return standins.race_lengths(standins.feed(spark, sf_dir)).select(
        "session_id",
        r6(race.burn_per_lap(total)).alias("burn_kg"),
        r6(race.seconds_per_lap(total)).alias("sec_per_lap"),
    )


FUEL = "CAST(greatest(0.0, 70.0 - 70.0 / CAST(total_laps AS DOUBLE) * (lap - 0.5)) AS DOUBLE)"


@query(
    "f2_fuel_penalty",
    f"""WITH {LAPS} SELECT session_id, driver, lap, round({FUEL}, 6) AS fuel_kg,
      round({FUEL} * 0.035, 6) AS penalty FROM laps""",
)
def fuel_penalty(spark, sf_dir):
    lap, total = F.col("lap"), F.col("total_laps")
    return standins.laps(spark, sf_dir).select(
        "session_id",
        "driver",
        "lap",
        r6(race.fuel_during_lap(lap, total)).alias("fuel_kg"),
        r6(race.fuel_penalty(lap, total)).alias("penalty"),
    )


@query(
    "f3_fuel_corrected",
    f"""WITH {LAPS} SELECT session_id, driver, lap,
      round(lap_time - {FUEL} * 0.035, 6) AS corrected FROM laps""",
)
def fuel_corrected(spark, sf_dir):
    corrected = race.fuel_corrected(F.col("lap_time"), F.col("lap"), F.col("total_laps"))
    return standins.laps(spark, sf_dir).select(
        "session_id", "driver", "lap", r6(corrected).alias("corrected")
    )


# Stand-in for a measured trend: the clean laps' plain slope of time over lap,
# NULL where all of them are the same lap.
TREND = f"""WITH {BEST}, trend AS (SELECT session_id, max(total_laps) AS total_laps,
  covar_pop(lap_time, lap) / nullif(var_pop(lap), 0) AS slope FROM clean GROUP BY session_id)"""


def _trend(spark, sf_dir):
    usable = clean.clean_laps(classified(spark, sf_dir))
    slope = F.covar_pop("lap_time", "lap") / F.nullif(F.var_pop("lap"), F.lit(0.0))
    return usable.groupBy("session_id").agg(
        F.max("total_laps").alias("total_laps"), slope.alias("slope")
    )


@query(
    "f4_fuel_calibrated",
    f"""{TREND} SELECT session_id,
      round(abs(slope) / (70.0 / CAST(total_laps AS DOUBLE)), 6) AS sec_per_kg FROM trend""",
)
def fuel_calibrated(spark, sf_dir):
    sensitivity = race.calibrated_seconds_per_kg(F.col("slope"), F.col("total_laps"))
    return _trend(spark, sf_dir).select("session_id", r6(sensitivity).alias("sec_per_kg"))


@query(
    "f5_fuel_cross_check",
    f"""{TREND} SELECT session_id,
      round(70.0 / CAST(total_laps AS DOUBLE) * 0.035, 6) AS prior_sec_per_lap,
      round(abs(slope) / (70.0 / CAST(total_laps AS DOUBLE)), 6) AS implied_sec_per_kg
    FROM trend""",
)
def fuel_cross_check(spark, sf_dir):
    total = F.col("total_laps")
    implied = race.implied_seconds_per_kg(F.col("slope"), race.burn_per_lap(total))
    return _trend(spark, sf_dir).select(
        "session_id",
        r6(race.seconds_per_lap(total)).alias("prior_sec_per_lap"),
        r6(implied).alias("implied_sec_per_kg"),
    )
