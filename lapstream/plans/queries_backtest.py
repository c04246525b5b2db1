"""Backtest over a series of laps (operator M12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.operators.laps import as_of_lap, lap_cutoffs
from lapstream.plans import backtest, standins
from lapstream.plans.oracle_views import LAPS
from lapstream.plans.queries_clean import BEST
from lapstream.plans.queries_pace import REFUSED
from lapstream.plans.registry import query, r6
from lapstream.session import cut_lineage

# Stand-in races are about 22 laps long.
ASKED = (8, 12, 16, 20)


def _inputs(spark, sf_dir):
    laps = standins.laps(spark, sf_dir)
    counts = standins.laps(spark, sf_dir, stints=False).select("session_id", "seq", "lap")
    return laps, counts


KNOWN = (
    LAPS
    + """,
want AS (SELECT CAST(unnest([8, 12, 16, 20]) AS BIGINT) AS as_of_lap),
cut AS (
  SELECT session_id, as_of_lap, min(CASE WHEN lap > as_of_lap THEN seq END) AS cutoff
  FROM laps CROSS JOIN want GROUP BY 1, 2 HAVING max(lap) >= as_of_lap),
known AS (
  SELECT l.*, as_of_lap FROM laps l JOIN cut USING (session_id) WHERE cutoff IS NULL OR seq <= cutoff),
best AS (
  SELECT session_id, as_of_lap, min(CASE WHEN status NOT IN ('4', '6') AND NOT entered_pit
    AND NOT exited_pit THEN lap_time END) AS best FROM known GROUP BY 1, 2),
kclean AS (
  SELECT k.* FROM known k JOIN best USING (session_id, as_of_lap)
  WHERE lap_time IS NOT NULL AND lap > 1 AND NOT entered_pit AND NOT exited_pit
    AND NOT (stint > 0 AND tyre_age = 0) AND status = '1' AND NOT retired
    AND NOT coalesce(gap_s < 2, FALSE) AND NOT coalesce(lap_time > best * CAST(1.4 AS DOUBLE), FALSE))"""
)


@query(
    "m12_known_laps",
    f"""WITH {KNOWN} SELECT session_id, as_of_lap, count(*) AS clean_laps, max(seq) AS last_seq
      FROM kclean GROUP BY 1, 2""",
)
def known_laps(spark, sf_dir):
    spans = backtest.lap_spans(*_inputs(spark, sf_dir), ASKED)
    runs = spans.groupBy("session_id", "since", "until").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    return backtest.over_laps(runs, ASKED).groupBy("session_id", "as_of_lap").agg(
        F.sum("n").alias("clean_laps"), F.max("last").alias("last_seq")
    )


@query(
    "m12_fit_groups",
    f"""WITH {KNOWN} SELECT session_id, as_of_lap, count(*) AS n_laps FROM kclean GROUP BY 1, 2
      HAVING count(*) >= 30 AND sum(CASE WHEN compound <> 'UNKNOWN' THEN 1 ELSE 0 END) > 0""",
)
def fit_groups(spark, sf_dir):
    fits = backtest.fits_as_of(*_inputs(spark, sf_dir), ASKED)
    return fits.select("session_id", "as_of_lap", "n_laps")


@query(
    "m12_cars_as_of",
    f"""WITH {KNOWN} SELECT session_id, as_of_lap, driver AS car, arg_max(compound, seq) AS compound,
      arg_max(stint, seq) AS stint FROM known GROUP BY 1, 2, 3""",
)
def cars_as_of(spark, sf_dir):
    laps, counts = _inputs(spark, sf_dir)
    deltas = laps.withColumnRenamed("driver", "car")
    return backtest.cars_as_of(deltas, counts, ("compound", "stint"), ASKED)


# A fit key is the session with the lap asked about, so the SQL of the fits serves as it is.
REFUSED_THEN = REFUSED.replace(
    BEST, f"{KNOWN}, clean AS (SELECT * REPLACE (session_id || '@' || as_of_lap AS session_id) FROM kclean)"
)


@query(
    "m12_backtest",
    f"""WITH RECURSIVE {REFUSED_THEN},
plays AS (
  SELECT k.*, lap % 12 AS option_id, session_id || '@' || as_of_lap AS fit FROM known k),
subject AS (
  SELECT fit, driver, max(total_laps) AS total, arg_max(position, lap) AS start FROM plays GROUP BY 1, 2),
scores AS (
  SELECT fit, session_id, as_of_lap, driver, option_id, total, start, avg(position) AS mean,
    avg(CAST(position <= 3 AS INT)) AS p3, avg(CAST(position <= 10 AS INT)) AS p10,
    avg(CAST(position < start AS INT)) AS gain, count(*) AS n
  FROM plays JOIN subject USING (fit, driver)
  WHERE fit IN (SELECT session_id FROM fitted) AND fit NOT IN (SELECT session_id FROM refused) GROUP BY ALL),
best_of AS (
  SELECT *, row_number() OVER w AS place, coalesce(lead(mean) OVER w - mean, 0) AS margin
  FROM scores WINDOW w AS (PARTITION BY fit, driver ORDER BY mean, option_id))
SELECT CAST(session_id AS VARCHAR) AS session, CAST(session_id % 10 AS VARCHAR) AS circuit, as_of_lap AS lap,
  total AS total_laps, driver, CAST(driver AS VARCHAR) AS tla, start AS position,
  least(as_of_lap + [0, 3, 6, 10][option_id // 3 + 1], total) AS pit_lap,
  ['SOF', 'MED', 'HAR'][option_id % 3 + 1] AS compound, round(mean, 6) AS expected_position,
  round(margin, 6) AS margin, margin >= CAST(0.15 AS DOUBLE) AS decisive, round(p3, 6) AS p_top3,
  round(p10, 6) AS p_points, round(gain, 6) AS p_gain, n AS n_sims,
  least(as_of_lap + 10, total) AS horizon_lap
FROM best_of WHERE place = 1""",
)
def run(spark, sf_dir):
    """Usable fits to prediction rows; laps of the car known by then play the draws."""
    laps, counts = _inputs(spark, sf_dir)
    fits = cut_lineage(backtest.fits_as_of(laps, counts, ASKED), "fits")
    keys = list(backtest.KEYS)
    placed = standins.laps(spark, sf_dir, position=True, stints=False)
    known = as_of_lap(placed, lap_cutoffs(counts, list(ASKED)))
    draws = cut_lineage(
        known.select(
            *keys, "driver", "lap", "position", "retired", "total_laps",
            F.floor(F.col("lap") / 12).alias("draw"), (F.col("lap") % 12).alias("option_id"),
        ).join(fits.select(*keys), keys, "left_semi"),
        "draws",
    )
    subjects = draws.groupBy(*keys, "driver").agg(
        F.max("total_laps").alias("total_laps"), F.max_by("position", "lap").alias("start_position")
    )
    named = subjects.withColumns(
        {
            "session": F.col("session_id").cast("string"),
            "circuit": (F.col("session_id") % 10).cast("string"),
            "tla": F.col("driver").cast("string"),
        }
    )
    rows = backtest.predictions(fits, named, draws)
    chances = ("expected_position", "margin", "p_top3", "p_points", "p_gain")
    return rows.withColumns({c: r6(c) for c in chances}).drop("id", "recorded_at", "note")
