"""Grid and option tables, outcome draws, and the ledger (groups K, L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.functions import text
from lapstream.operators import fold, grid, ledger, outcomes
from lapstream.plans import standins
from lapstream.plans.oracle_views import CARS, DRAWS, LAPS, PREDS
from lapstream.plans.queries_feed import _cars
from lapstream.plans.registry import joined, query, r6
from lapstream.session import cut_lineage

# Cars of the feed in running order; the interval text plays the gap, since it
# holds both seconds and laps down.
ORDER = (
    CARS
    + """,
ordered AS (
  SELECT session_id, car, tla, tyre_age, compound,
    row_number() OVER (PARTITION BY session_id
      ORDER BY position IS NULL, CASE WHEN position = 0 THEN 999 ELSE position END, first_seen)
      AS place,
    CASE WHEN ival LIKE '+%' THEN CAST(substr(ival, 2) AS DOUBLE) END AS gap,
    CASE WHEN ival LIKE '%L' THEN 1 ELSE 0 END AS down
  FROM cars),
walk AS (
  SELECT session_id, place, car, CAST(0 AS DOUBLE) AS elapsed FROM ordered WHERE place = 1
  UNION ALL
  SELECT o.session_id, o.place, o.car, CASE WHEN o.down > 0 THEN w.elapsed + 40 * o.down
      WHEN o.gap >= w.elapsed THEN o.gap ELSE w.elapsed + 1.5 END
  FROM walk w JOIN ordered o ON o.session_id = w.session_id AND o.place = w.place + 1)"""
)


def _placed(spark, sf_dir):
    cars = _cars(spark, sf_dir).withColumn("gap_to_leader", F.col("interval_text"))
    return cut_lineage(grid.with_place(cars), "placed")


def _timed(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    times = grid.ordered_gaps(placed)
    return cut_lineage(placed.drop("place").join(times, ["session_id", "car"]), "timed")


def _pace(spark, sf_dir):
    """Stand-in for fitted pace: mean lap time, unknown for cars without one."""
    rows = standins.laps(spark, sf_dir, stints=False)
    return rows.groupBy(F.col("session_id").cast("string").alias("session_id"), "driver").agg(
        F.avg("lap_time").alias("pace")
    )


PACE = """pace AS (SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver AS VARCHAR) AS car,
  driver, avg(lap_time) AS pace FROM laps GROUP BY 1, 2, 3)"""


@query(
    "k1_ordered_gaps",
    f"WITH RECURSIVE {ORDER} SELECT session_id, car, place, round(elapsed, 6) AS elapsed FROM walk",
)
def ordered_gaps(spark, sf_dir):
    found = grid.ordered_gaps(_placed(spark, sf_dir))
    return found.withColumn("elapsed", r6("elapsed"))


@query(
    "k1_ordered_gaps_chunked",
    f"WITH RECURSIVE {ORDER} SELECT session_id, car, place, round(elapsed, 6) AS elapsed FROM walk",
)
def ordered_gaps_chunked(spark, sf_dir):
    """The same fold in chunks of three cars, as it runs on very large fields."""
    cars = _cars(spark, sf_dir).withColumn("gap_to_leader", F.col("interval_text"))
    found = grid.ordered_gaps(grid.with_place(cars), chunk=3)
    return found.withColumn("elapsed", r6("elapsed"))


@query(
    "k2_grid_entries",
    f"""WITH RECURSIVE {ORDER}, {LAPS[LAPS.index("lap1 AS"):]}, {PACE}
    SELECT w.session_id, w.car, round(w.elapsed, 6) AS elapsed, o.tyre_age, o.compound,
      coalesce(nullif(o.tla, ''), w.car) AS tla, round(coalesce(p.pace, 0), 6) AS base_pace
    FROM walk w JOIN ordered o USING (session_id, car) LEFT JOIN pace p USING (session_id, car)""",
)
def grid_entries(spark, sf_dir):
    found = grid.grid_entries(_placed(spark, sf_dir), _pace(spark, sf_dir))
    return found.withColumns({"elapsed": r6("elapsed"), "base_pace": r6("base_pace")}).drop(
        "place", "stops"
    )


@query(
    "k3_pace_ladder",
    f"""WITH {LAPS}, {PACE} SELECT session_id, driver, round((row_number() OVER (
        PARTITION BY session_id ORDER BY pace NULLS LAST, driver) - 1) * CAST(0.6 AS DOUBLE), 6) AS elapsed
    FROM pace""",
)
def pace_ladder(spark, sf_dir):
    return grid.pace_ladder(cut_lineage(_pace(spark, sf_dir), "pace")).select("session_id", "driver", r6("elapsed").alias("elapsed"))


@query(
    "k4_candidate_options",
    f"""WITH {LAPS}, s AS (SELECT session_id, max(total_laps) AS total_laps,
        max(total_laps) - 5 AS lap FROM laps GROUP BY 1),
      d AS (SELECT CAST(unnest([0, 3, 6, 10]) AS BIGINT) AS delay),
      c AS (SELECT unnest(['SOFT', 'MEDIUM', 'HARD']) AS option_compound)
    SELECT session_id, delay, option_compound, least(lap + delay, total_laps) AS pit_lap,
      CASE WHEN delay = 0 THEN 'now' ELSE 'lap +' || delay END || ' on ' || left(option_compound, 3)
        AS label
    FROM s CROSS JOIN d CROSS JOIN c""",
)
def candidate_options(spark, sf_dir):
    state = standins.race_lengths(standins.feed(spark, sf_dir)).withColumn(
        "lap", F.col("total_laps") - 5
    )
    return grid.candidate_options(state).drop("option_id", "lap", "total_laps")


@query(
    "k5_threat_candidates",
    f"""WITH RECURSIVE {ORDER}, s AS (SELECT session_id, car AS subject, elapsed AS ours
        FROM walk WHERE place = 1)
    SELECT w.session_id, subject, w.car, round(w.elapsed - ours, 6) AS gap
    FROM walk w JOIN s USING (session_id)
    WHERE w.car <> subject AND w.elapsed - ours > 0 AND w.elapsed - ours <= 4""",
)
def threat_candidates(spark, sf_dir):
    timed = _timed(spark, sf_dir)
    found = grid.threat_candidates(timed, timed.where("place = 1"))
    return found.select("session_id", "subject", "car", r6("gap").alias("gap"))


@query(
    "k6_subject_car",
    f"""WITH {ORDER.replace("walk AS", "unused AS").split("unused AS")[0].rstrip().rstrip(",")}
    SELECT session_id, arg_min(car, place + CASE WHEN tla = 'T42' THEN 0 ELSE 1000000 END) AS car
    FROM ordered GROUP BY session_id""",
)
def subject_car(spark, sf_dir):
    return grid.subject_car(_placed(spark, sf_dir), "T42").select("session_id", "car")


@query(
    "k7_current_position",
    f"""WITH RECURSIVE {ORDER} SELECT session_id, car, row_number() OVER (
        PARTITION BY session_id ORDER BY elapsed, place) AS current_position FROM walk""",
)
def current_position(spark, sf_dir):
    found = grid.current_position(_timed(spark, sf_dir))
    return found.select("session_id", "car", "current_position")


def _subjects(spark, sf_dir):
    rows = standins.laps(spark, sf_dir, position=True, stints=False)
    last = rows.groupBy("session_id", "driver").agg(F.max_by("position", "lap").alias("start_position"))
    return last.groupBy("session_id").agg(
        F.min("driver").alias("driver"),
        F.min_by("start_position", "driver").alias("start_position"),
    )


@query(
    "l1_classify_draws",
    f"""WITH {DRAWS} SELECT session_id, option_id, draw, driver, row_number() OVER (
        PARTITION BY session_id, option_id, draw ORDER BY retired,
        CASE WHEN retired THEN total_laps - retired_on ELSE elapsed END, driver) AS classified
    FROM draws""",
)
def classify_draws(spark, sf_dir):
    found = outcomes.classify_draws(standins.draws(spark, sf_dir))
    return found.select("session_id", "option_id", "draw", "driver", "classified")


@query(
    "l2_mean_position",
    f"""WITH {DRAWS} SELECT session_id, option_id, driver,
      round(avg(CAST(position AS DOUBLE)), 6) AS mean_position FROM draws GROUP BY 1, 2, 3""",
)
def mean_position(spark, sf_dir):
    found = outcomes.car_outcomes(standins.draws(spark, sf_dir))
    return found.select(*outcomes.CAR, r6("mean_position").alias("mean_position"))


@query(
    "l3_position_distribution",
    f"""WITH {DRAWS} SELECT session_id, option_id, driver, string_agg(position || ':'
        || CAST(round(probability * 1000000) AS BIGINT), ',' ORDER BY position) AS spread
    FROM dist GROUP BY 1, 2, 3""",
)
def position_distribution(spark, sf_dir):
    found = outcomes.distribution(standins.draws(spark, sf_dir))
    entry = F.transform(
        F.array_sort(F.map_entries("distribution")),
        lambda e: F.concat_ws(
            ":", e["key"].cast("string"), F.round(e["value"] * 1000000).cast("bigint").cast("string")
        ),
    )
    return found.select(*outcomes.CAR, F.array_join(entry, ",").alias("spread"))


@query(
    "l4_probability_top",
    f"""WITH {DRAWS} SELECT session_id, option_id, driver,
      round(avg(CAST(position <= 5 AS INT)), 6) AS probability FROM draws GROUP BY 1, 2, 3""",
)
def probability_top(spark, sf_dir):
    found = outcomes.probability_top(standins.draws(spark, sf_dir), 5)
    return found.withColumn("probability", r6("probability"))


AHEAD = """ahead AS (
  SELECT d.session_id, d.option_id, o.driver AS subject, d.driver,
    avg(CAST(d.position < o.position AS INT)) AS probability
  FROM draws d JOIN subject s USING (session_id)
    JOIN draws o ON o.session_id = d.session_id AND o.option_id = d.option_id AND o.draw = d.draw
      AND o.driver = s.driver
  WHERE d.driver <> s.driver GROUP BY 1, 2, 3, 4)"""


@query(
    "l5_ahead_of",
    f"""WITH {DRAWS}, {AHEAD} SELECT session_id, option_id, subject, driver,
      round(probability, 6) AS probability FROM ahead""",
)
def ahead_of(spark, sf_dir):
    draws = cut_lineage(standins.draws(spark, sf_dir), "draws")
    found = outcomes.ahead_of(draws, _subjects(spark, sf_dir))
    return found.withColumn("probability", r6("probability"))


@query(
    "l6_probability_retired",
    f"""WITH {DRAWS} SELECT session_id, option_id, driver,
      round(avg(CAST(retired AS INT)), 6) AS p_retired,
      round(1 - avg(CAST(retired AS INT)), 6) AS p_finished FROM draws GROUP BY 1, 2, 3""",
)
def probability_retired(spark, sf_dir):
    found = outcomes.car_outcomes(standins.draws(spark, sf_dir))
    return found.select(
        *outcomes.CAR, r6("p_retired").alias("p_retired"), r6("p_finished").alias("p_finished")
    )


def _board(spark, sf_dir):
    draws = cut_lineage(standins.draws(spark, sf_dir), "draws")
    return outcomes.option_scoreboard(draws, _subjects(spark, sf_dir))


CHANCES = ("mean_position", "p_top3", "p_points", "p_gain", "p_retire")


@query(
    "l7_option_scoreboard",
    f"""WITH {DRAWS} SELECT session_id, option_id, driver, n_sims,
      {", ".join(f"round({c}, 6) AS {c}" for c in CHANCES)} FROM board""",
)
def option_scoreboard(spark, sf_dir):
    found = _board(spark, sf_dir).drop("distribution", "start_position")
    return found.withColumns({c: r6(c) for c in CHANCES})


RANKED = """ranked AS (
  SELECT *, row_number() OVER w AS rank,
    coalesce(lead(mean_position) OVER w - mean_position, 0) AS margin
  FROM board WINDOW w AS (PARTITION BY session_id ORDER BY mean_position, option_id))"""


@query(
    "l8_option_ranking",
    f"""WITH {DRAWS}, {RANKED} SELECT session_id, option_id, CAST(rank AS INT) AS rank,
      round(margin, 6) AS margin, margin >= CAST(0.15 AS DOUBLE) AS decisive FROM ranked""",
)
def option_ranking(spark, sf_dir):
    found = outcomes.rank_options(_board(spark, sf_dir))
    return found.select("session_id", "option_id", "rank", r6("margin").alias("margin"), "decisive")


@query(
    "l8_recommendation",
    f"""WITH {DRAWS}, {RANKED} SELECT session_id, option_id, round(mean_position, 6) AS mean_position
      FROM ranked WHERE rank = 1""",
)
def recommendation(spark, sf_dir):
    found = outcomes.recommendation(_board(spark, sf_dir))
    return found.select("session_id", "option_id", r6("mean_position").alias("mean_position"))


@query(
    "l9_threat_ranking",
    f"""WITH {DRAWS}, {AHEAD} SELECT session_id, option_id, subject, driver,
      round(probability, 6) AS probability FROM ahead""",
)
def threat_ranking(spark, sf_dir):
    cars = standins.feed(spark, sf_dir).select("session_id", "driver").distinct()
    subjects = _subjects(spark, sf_dir)
    candidates = cars.join(
        subjects.select("session_id", F.col("driver").alias("subject")), "session_id"
    ).where(F.col("driver") != F.col("subject"))
    draws = cut_lineage(standins.draws(spark, sf_dir), "draws")
    found = outcomes.threat_ranking(draws, candidates)
    return found.withColumn("probability", r6("probability"))


@query(
    "l10_likely_core",
    f"""WITH {DRAWS}, c AS (SELECT *, coalesce(sum(probability) OVER (
        PARTITION BY session_id, option_id, driver ORDER BY probability DESC, position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dist)
    SELECT session_id, option_id, driver, min(position) AS low, max(position) AS high,
      arg_max(position, probability * 1000000 - position) AS mode, round(sum(probability), 6) AS mass
    FROM c WHERE before < 0.95 - 1e-9 GROUP BY 1, 2, 3""",
)
def likely_core(spark, sf_dir):
    found = outcomes.likely_core(outcomes.position_probabilities(standins.draws(spark, sf_dir)))
    return found.withColumn("mass", r6("mass"))


# --- ledger -------------------------------------------------------------------


@query(
    "m1_prediction_rows",
    f"""WITH {DRAWS}, {RANKED} SELECT CAST(r.session_id AS VARCHAR) AS session,
      CAST(r.driver AS VARCHAR) AS driver,
      CASE option_id WHEN 0 THEN 'SOF' WHEN 1 THEN 'MED' WHEN 2 THEN 'HAR' ELSE 'INT' END AS compound,
      round(mean_position, 6) AS expected_position, round(margin, 6) AS margin,
      least(t.total // 2 + 10, t.total) AS horizon_lap
    FROM ranked r JOIN (SELECT session_id, max(total_laps) AS total FROM laps GROUP BY 1) t
      USING (session_id) WHERE rank = 1""",
)
def prediction_rows(spark, sf_dir):
    best = outcomes.recommendation(_board(spark, sf_dir))
    total = standins.race_lengths(standins.feed(spark, sf_dir))
    option = F.col("option_id")
    filled = best.join(total, "session_id").withColumns(
        {
            "session": F.col("session_id").cast("string"),
            "circuit": (F.col("session_id") % 10).cast("string"),
            "lap": F.floor(F.col("total_laps") / 2),
            "driver": F.col("driver").cast("string"),
            "tla": F.col("driver").cast("string"),
            "position": F.col("start_position"),
            "pit_lap": F.floor(F.col("total_laps") / 2),
            "option_compound": F.when(option == 0, "SOFT")
            .when(option == 1, "MEDIUM")
            .when(option == 2, "HARD")
            .otherwise("INTERMEDIATE"),
            "expected_position": F.col("mean_position"),
        }
    )
    rows = ledger.prediction_rows(filled)
    return rows.select(
        "session", "driver", "compound", r6("expected_position").alias("expected_position"),
        r6("margin").alias("margin"), "horizon_lap",
    )


@query(
    "m2_finishing_positions",
    f"WITH {CARS} SELECT session_id, car AS driver, position AS actual FROM cars WHERE position IS NOT NULL",
)
def finishing_positions(spark, sf_dir):
    return ledger.finishing_positions(_cars(spark, sf_dir))


def _pairs(spark, sf_dir):
    return ledger.scored_pairs(standins.predictions(spark, sf_dir), standins.finish(spark, sf_dir))


def _card(spark, sf_dir):
    return ledger.scorecard(_pairs(spark, sf_dir))


@query("m3_scored_pairs", f"WITH {PREDS} SELECT session_id, driver, actual FROM pair")
def scored_pairs(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).where(F.col("actual").isNotNull())
    return pairs.select("session_id", "driver", "actual")


@query(
    "m3_skipped",
    f"""WITH {PREDS} SELECT p.session_id, p.driver FROM preds p LEFT JOIN fin f
      USING (session_id, driver) WHERE f.actual IS NULL""",
)
def skipped(spark, sf_dir):
    missed = ledger.skipped(standins.predictions(spark, sf_dir), standins.finish(spark, sf_dir))
    return missed.select("session_id", "driver")


BRIERS = ("brier_top3", "brier_points", "baseline_top3", "baseline_points")
ERRORS = ("position_error", "baseline_position_error")


@query(
    "m4_brier",
    f"""WITH {PREDS} SELECT session_id, n, {", ".join(f"round({c}, 6) AS {c}" for c in BRIERS)}
      FROM card""",
)
def brier(spark, sf_dir):
    return _card(spark, sf_dir).select("session_id", "n", *[r6(c).alias(c) for c in BRIERS])


@query(
    "m5_position_error",
    f"""WITH {PREDS} SELECT session_id, {", ".join(f"round({c}, 6) AS {c}" for c in ERRORS)}
      FROM card""",
)
def position_error(spark, sf_dir):
    return _card(spark, sf_dir).select("session_id", *[r6(c).alias(c) for c in ERRORS])


# Averages differ in the last bit with the order of summing, so the value is
# rounded before it is put into words.
SKILL_TEXT = """CASE WHEN {c} = CAST('-inf' AS DOUBLE) THEN 'worse*'
  ELSE printf('%+.1f%%', round({c}, 6) * 100) END"""


@query(
    "m6_skill",
    f"""WITH {PREDS} SELECT session_id,
      CASE WHEN isinf(skill_top3) THEN 'worse*' ELSE CAST(CAST(round(skill_top3 * 10000) AS BIGINT)
        AS VARCHAR) END AS skill_top3,
      CASE WHEN isinf(skill_points) THEN 'worse*' ELSE CAST(CAST(round(skill_points * 10000)
        AS BIGINT) AS VARCHAR) END AS skill_points FROM skilled""",
)
def skill(spark, sf_dir):
    def shown(c):
        lost = F.col(c) == F.lit(float("-inf"))
        return F.when(lost, "worse*").otherwise(
            F.round(F.when(~lost, F.col(c)) * 10000).cast("bigint").cast("string")
        )

    return _card(spark, sf_dir).select(
        "session_id", *[shown(c).alias(c) for c in ("skill_top3", "skill_points")]
    )


@query(
    "b17_format_skill",
    f"""WITH {PREDS} SELECT session_id, {SKILL_TEXT.format(c="skill_top3")} AS skill_top3_text,
      {SKILL_TEXT.format(c="skill_points")} AS skill_points_text FROM skilled""",
)
def format_skill(spark, sf_dir):
    card = _card(spark, sf_dir)
    for c in ("skill_top3", "skill_points"):
        lost = F.col(c) == F.lit(float("-inf"))
        card = card.withColumn(c, F.when(lost, F.col(c)).otherwise(r6(c)))
    return ledger.with_skill_text(card).select(
        "session_id", "skill_top3_text", "skill_points_text"
    )


BEATS = "skill_top3 > 0 AND position_error < baseline_position_error"


@query("m7_beats_baseline", f"WITH {PREDS} SELECT session_id, {BEATS} AS beats_baseline FROM skilled")
def beats_baseline(spark, sf_dir):
    return _card(spark, sf_dir).select("session_id", "beats_baseline")


@query(
    "m8_calibration",
    f"""WITH {PREDS}, bins AS (SELECT * FROM (VALUES (0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8),
        (0.8, 1.0)) b(low, high)),
      placed AS (SELECT session_id, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, p_top3, t3
        FROM pair JOIN bins ON p_top3 >= CAST(low AS DOUBLE)
          AND (p_top3 < CAST(high AS DOUBLE) OR (high = 1.0 AND p_top3 = 1)))
    SELECT session_id, low, high, count(*) AS n, round(avg(p_top3), 6) AS predicted,
      round(avg(t3), 6) AS observed, round(avg(p_top3) - avg(t3), 6) AS gap
    FROM placed GROUP BY 1, 2, 3""",
)
def calibration(spark, sf_dir):
    found = ledger.calibration(_pairs(spark, sf_dir))
    return found.withColumns({c: r6(c) for c in ("predicted", "observed", "gap")})


@query(
    "m9_caveats",
    f"""WITH {PREDS} SELECT session_id, concat_ws(',',
        CASE WHEN n > 0 AND n < 10 THEN 'few scored: ' || n END,
        CASE WHEN n_skipped > 0 THEN 'skipped without a finish: ' || n_skipped END) AS caveats
    FROM skilled""",
)
def caveats(spark, sf_dir):
    return _card(spark, sf_dir).select("session_id", joined("caveats").alias("caveats"))


@query(
    "m10_verdict",
    f"""WITH {PREDS} SELECT session_id, CASE WHEN n = 0 THEN 'nothing' WHEN n < 10 THEN 'too few'
      WHEN {BEATS} THEN 'beat' WHEN skill_top3 > 0 THEN 'partial' ELSE 'lost' END AS verdict
    FROM skilled""",
)
def verdict(spark, sf_dir):
    return _card(spark, sf_dir).select("session_id", "verdict")


@query(
    "m11_call_table",
    f"""WITH {PREDS} SELECT p.session_id, p.lap, CAST(p.driver AS VARCHAR) AS code,
      'pit lap ' || p.lap + 3 || ' on HAR' AS call, round(expected_position, 6) AS expected_position,
      CASE WHEN actual IS NULL THEN 'DNF' ELSE 'P' || actual END AS result,
      least(p.lap + 10, p.total_laps) AS horizon_lap
    FROM preds p LEFT JOIN fin USING (session_id, driver)""",
)
def call_table(spark, sf_dir):
    calls = standins.predictions(spark, sf_dir).withColumns(
        {
            "tla": F.col("driver").cast("string"),
            "pit_lap": F.col("lap") + 3,
            "compound": F.lit("HAR"),
            "horizon_lap": F.least(F.col("lap") + ledger.HORIZON_LAPS, F.col("total_laps")),
        }
    )
    found = ledger.call_table(calls, standins.finish(spark, sf_dir))
    return found.withColumn("expected_position", r6("expected_position"))


@query(
    "b15_option_labels",
    f"""WITH {LAPS} SELECT seq, CASE WHEN k % 4 = 0 THEN 'now' ELSE 'lap +' || k % 4 END || ' on '
        || CASE compound WHEN 'SOFT' THEN 'SOF' WHEN 'MEDIUM' THEN 'MED' WHEN 'HARD' THEN 'HAR'
           ELSE '---' END AS label,
      'pit ' || CASE WHEN k % 30 <= lap THEN 'now' ELSE 'lap ' || k % 30 END || ' on HAR' AS call
    FROM laps""",
)
def option_labels(spark, sf_dir):
    rows = standins.laps(spark, sf_dir)
    return rows.select(
        "seq",
        text.option_label(F.col("k") % 4, F.col("compound")).alias("label"),
        text.call_text(F.col("lap"), F.col("k") % 30, F.lit("HAR")).alias("call"),
    )
