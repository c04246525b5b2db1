"""Pace decomposition (inventory group G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapstream.operators import clean, pace
from lapstream.plans.queries_clean import BEST, classified
from lapstream.plans.registry import joined, query, r6
from lapstream.session import cut_lineage

KEYS = ["session_id"]
CODE = "CASE compound WHEN 'HARD' THEN 'HAR' WHEN 'MEDIUM' THEN 'MED' WHEN 'SOFT' THEN 'SOF' ELSE left(compound, 3) END"

FIT = (
    BEST
    + """,
fits AS (
  SELECT session_id, count(*) AS n_laps, max(lap) AS max_lap,
    sum(CASE WHEN compound <> 'UNKNOWN' THEN 1 ELSE 0 END) AS known_laps
  FROM clean WHERE lap_time IS NOT NULL AND lap >= 1 GROUP BY session_id
  HAVING count(*) >= 30 AND sum(CASE WHEN compound <> 'UNKNOWN' THEN 1 ELSE 0 END) > 0),
used AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY laps DESC, first_seen) AS place
  FROM (SELECT session_id, compound, count(*) AS laps, min(seq) AS first_seen,
      median(lap) AS phase FROM clean WHERE compound <> 'UNKNOWN' GROUP BY 1, 2)),
ref AS (SELECT session_id, compound AS reference FROM used WHERE place = 1),
rows AS (SELECT c.*, reference FROM clean c JOIN ref USING (session_id)),
feat AS (
  SELECT session_id, seq, 1 AS cls, 'driver:' || driver AS feature, CAST(1 AS DOUBLE) AS v FROM rows
  UNION ALL SELECT session_id, seq, 2, 'lap', lap FROM rows
  UNION ALL SELECT session_id, seq, 3, 'age:' || compound, tyre_age FROM rows
    WHERE compound <> 'UNKNOWN'
  UNION ALL SELECT session_id, seq, 4, 'offset:' || compound, 1 FROM rows
    WHERE compound <> 'UNKNOWN' AND compound <> reference)"""
)

# Least squares by elimination of the normal equations, one matrix per fit. A column that
# depends on those before it leaves a pivot of nothing; it gets coefficient 0 and does not
# count for the rank, which changes neither the residuals nor, at full rank, anything.
SOLVE = (
    FIT
    + """,
y AS (
  SELECT r.session_id, r.seq, lap_time - avg(lap_time) OVER (PARTITION BY r.session_id) AS y,
    avg(lap_time) OVER (PARTITION BY r.session_id) AS level
  FROM rows r JOIN fits USING (session_id)),
fidx AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cls, feature) AS i
  FROM (SELECT DISTINCT session_id, cls, feature FROM feat JOIN fits USING (session_id))),
cell AS (
  SELECT f.session_id, i, seq, v FROM feat f JOIN fidx USING (session_id, cls, feature)),
prod AS (
  SELECT a.session_id, a.i, b.i AS j, sum(a.v * b.v) AS v
  FROM cell a JOIN cell b ON a.session_id = b.session_id AND a.seq = b.seq GROUP BY 1, 2, 3),
rhs AS (SELECT session_id, i, sum(v * y) AS v FROM cell JOIN y USING (session_id, seq) GROUP BY 1, 2),
dense AS (
  SELECT a.session_id, a.i, list(coalesce(p.v, 0) ORDER BY b.i) AS r
  FROM fidx a JOIN fidx b ON a.session_id = b.session_id
    LEFT JOIN prod p ON p.session_id = a.session_id AND p.i = a.i AND p.j = b.i
  GROUP BY 1, 2),
mats AS (
  SELECT session_id, count(*) AS w, list(list_append(r, v) ORDER BY i) AS m, list(r[i] ORDER BY i) AS d,
    list(v ORDER BY i) AS b
  FROM dense JOIN rhs USING (session_id, i) GROUP BY 1),
elim AS (
  SELECT session_id, w, m, d, b, 1 AS k, CAST([] AS BOOLEAN[]) AS live FROM mats
  UNION ALL
  SELECT session_id, w, CASE WHEN m[k][k] > 1e-9 * d[k] THEN list_transform(m, lambda r, n:
      CASE WHEN n = k THEN list_transform(r, lambda x: x / m[k][k])
      ELSE list_transform(list_zip(r, m[k]), lambda z: z[1] - r[k] / m[k][k] * z[2]) END) ELSE m END,
    d, b, k + 1, list_append(live, m[k][k] > 1e-9 * d[k])
  FROM elim WHERE k <= w),
beta AS (
  SELECT session_id, cls, feature, i, CASE WHEN live[i] THEN m[i][w + 1] ELSE 0 END AS beta
  FROM elim JOIN fidx USING (session_id) WHERE k = w + 1),
quality AS (
  SELECT e.session_id, w AS width, len(list_filter(live, lambda x: x)) AS rank, n,
    tss, tss - (SELECT sum(beta * b[t.i]) FROM beta t WHERE t.session_id = e.session_id) AS rss, level
  FROM elim e JOIN (SELECT session_id, count(*) AS n, sum(y * y) AS tss, any_value(level) AS level
    FROM y GROUP BY 1) USING (session_id) WHERE k = w + 1),
fitted AS (
  SELECT q.session_id, rank, width, rank = width AS whole, n,
    max(CASE WHEN cls = 2 THEN beta END) AS trend,
    max(CASE WHEN cls = 1 THEN beta END) - min(CASE WHEN cls = 1 THEN beta END) AS pace_spread,
    sqrt(greatest(rss, 0) / (n - least(width, n - 1))) AS residual_std, 1 - rss / tss AS r_squared
  FROM quality q JOIN beta USING (session_id) GROUP BY ALL),
wear AS (
  SELECT session_id, substr(a.feature, 5) AS compound, a.beta AS degradation, coalesce(o.beta, 0) AS "offset"
  FROM beta a LEFT JOIN beta o ON o.session_id = a.session_id AND o.cls = 4
    AND substr(o.feature, 8) = substr(a.feature, 5) WHERE a.cls = 3)"""
)
SOLVE = SOLVE.replace("SELECT session_id, substr(a.feature, 5)", "SELECT a.session_id, substr(a.feature, 5)")


def cleaned(spark, sf_dir):
    return clean.clean_laps(classified(spark, sf_dir))


def _reference(usable):
    used = pace.compound_usage(usable, KEYS)
    return used.where("is_reference").select("session_id", F.col("compound").alias("reference"))


@query("g1_fit_groups", f"WITH {FIT} SELECT session_id, n_laps FROM fits")
def fit_groups(spark, sf_dir):
    found = pace.fit_groups(pace.usable_laps(cleaned(spark, sf_dir)), KEYS)
    return found.select("session_id", "n_laps")


@query("g2_reference_compound", f"WITH {FIT} SELECT session_id, reference FROM ref")
def reference_compound(spark, sf_dir):
    return _reference(pace.usable_laps(cleaned(spark, sf_dir)))


@query(
    "g3_design",
    f"""WITH {FIT} SELECT session_id, feature, count(*) AS rows, round(sum(v), 6) AS total
      FROM feat GROUP BY 1, 2""",
)
def design(spark, sf_dir):
    usable = pace.usable_laps(cleaned(spark, sf_dir))
    lap_rows = pace.design(usable, _reference(usable), KEYS)
    return (
        lap_rows.select("session_id", F.inline("features"))
        .groupBy("session_id", "feature")
        .agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("value")).alias("total"))
    )


@query(
    "g4_normal_equations",
    f"""WITH {FIT}, ally AS (SELECT * FROM feat
        UNION ALL SELECT session_id, seq, 5, 'y', lap_time FROM rows)
      SELECT a.session_id, a.feature AS i, b.feature AS j, round(sum(a.v * b.v), 4) AS value
      FROM ally a JOIN ally b ON a.seq = b.seq AND a.cls <= b.cls GROUP BY 1, 2, 3""",
)
def normal_equations(spark, sf_dir):
    usable = pace.usable_laps(cleaned(spark, sf_dir))
    cells = pace.normal_equations(pace.moments(usable, KEYS), _reference(usable), KEYS)
    return cells.withColumn("value", F.round("value", 4))


@query(
    "g8_compound_phase",
    f"""WITH {FIT} SELECT session_id, compound, round(phase, 6) AS phase FROM used""",
)
def compound_phase(spark, sf_dir):
    used = pace.compound_usage(pace.usable_laps(cleaned(spark, sf_dir)), KEYS)
    return used.select("session_id", "compound", r6("phase").alias("phase"))


def fits(spark, sf_dir):
    return pace.fit_pace(cut_lineage(cleaned(spark, sf_dir), "clean"), KEYS)


def _whole(value):
    """A value that only a fit of full rank determines."""
    return F.when(F.col("rank") == F.col("width"), value)


@query(
    "g5_pace_fit",
    f"""WITH RECURSIVE {SOLVE} SELECT session_id, rank, width,
      CASE WHEN whole THEN round(trend, 5) END AS trend FROM fitted""",
)
def pace_fit(spark, sf_dir):
    return fits(spark, sf_dir).select(
        "session_id", "rank", "width", _whole(F.round("trend", 5)).alias("trend")
    )


@query(
    "g6_fit_quality",
    # Spread of the lap times needs no solve, so SQL can confirm it and the sample.
    f"""WITH {FIT} SELECT session_id, n_laps, round(stddev_pop(lap_time), 6) AS total_std
      FROM rows JOIN fits USING (session_id) GROUP BY 1, 2""",
)
def fit_quality(spark, sf_dir):
    spread = F.sqrt(F.col("ss_tot") / F.col("n_laps"))
    return fits(spark, sf_dir).select("session_id", "n_laps", r6(spread).alias("total_std"))


@query(
    "g6_residuals",
    f"""WITH RECURSIVE {SOLVE} SELECT session_id, round(residual_std, 5) AS residual_std,
      round(r_squared, 5) AS r_squared FROM fitted""",
)
def residuals(spark, sf_dir):
    return fits(spark, sf_dir).select(
        "session_id",
        F.round("residual_std", 5).alias("residual_std"),
        F.round("r_squared", 5).alias("r_squared"),
    )


@query(
    "g7_coefficients",
    f"""WITH RECURSIVE {SOLVE} SELECT session_id, round(trend, 5) AS trend, compound,
      round(degradation, 5) AS degradation, round("offset", 4) AS "offset"
    FROM wear JOIN fitted USING (session_id) WHERE whole""",
)
def coefficients(spark, sf_dir):
    whole = fits(spark, sf_dir).where(F.col("rank") == F.col("width"))
    return pace.coefficient_rows(whole).withColumns(
        {"trend": F.round("trend", 5), "degradation": F.round("degradation", 5), "offset": F.round("offset", 4)}
    )


@query(
    "g7_driver_pace",
    f"""WITH RECURSIVE {SOLVE} SELECT session_id, CAST(substr(feature, 8) AS BIGINT) AS driver,
      round(beta + level, 4) AS pace
    FROM beta JOIN quality USING (session_id) WHERE cls = 1 AND rank = width""",
)
def driver_pace(spark, sf_dir):
    usable = cut_lineage(cleaned(spark, sf_dir), "clean")
    whole = pace.fit_pace(usable, KEYS).where(F.col("rank") == F.col("width"))
    return pace.pace_table(usable, whole, KEYS).withColumn("pace", F.round("pace", 4))


@query(
    "g9_stints",
    f"""WITH {FIT} SELECT session_id, count(*) AS n_stints, count(*) < 2 AS single_stint FROM (
        SELECT DISTINCT session_id, driver, stint FROM rows JOIN fits USING (session_id))
      GROUP BY session_id""",
)
def stints(spark, sf_dir):
    single = F.exists("warnings", lambda w: w.startswith("single stint"))
    return fits(spark, sf_dir).select("session_id", "n_stints", single.alias("single_stint"))


@query(
    "g9_phase_warning",
    f"""WITH {FIT} SELECT session_id, count(*) > 1 AND (max(phase) - min(phase))
        / CAST(any_value(max_lap) AS DOUBLE) > CAST(0.35 AS DOUBLE) AS separated
      FROM used JOIN fits USING (session_id) GROUP BY session_id""",
)
def phase_warning(spark, sf_dir):
    return fits(spark, sf_dir).select("session_id", pace.phase_separated().alias("separated"))


REFUSED = (
    SOLVE
    + f""",
said AS (
  SELECT session_id, printf('positive trend: %+.4f s/lap', trend) AS text FROM fitted WHERE whole AND trend > 0
  UNION ALL SELECT session_id, printf('driver spread %.1f s', pace_spread) FROM fitted
    WHERE whole AND pace_spread > 10
  UNION ALL SELECT session_id, printf('%s wear out of range: %+.2f s/lap', {CODE}, degradation)
    FROM wear JOIN fitted USING (session_id) WHERE whole AND abs(degradation) > 1
  UNION ALL SELECT session_id, 'effects not identified' FROM fitted WHERE NOT whole),
refused AS (SELECT session_id, string_agg(text, ',' ORDER BY text) AS refusals FROM said GROUP BY 1)"""
)


@query(
    "g10_usable_fits",
    f"""WITH RECURSIVE {REFUSED}, warned AS (
      SELECT session_id, 'compounds separated by race phase' AS text FROM (SELECT session_id,
          count(*) > 1 AND (max(phase) - min(phase)) / CAST(any_value(max_lap) AS DOUBLE)
            > CAST(0.35 AS DOUBLE) AS apart FROM used JOIN fits USING (session_id) GROUP BY 1) WHERE apart
      UNION ALL SELECT session_id, printf('%s wear negative: %+.4f s/lap', {CODE}, degradation)
        FROM wear WHERE degradation < 0)
    SELECT f.session_id, round(trend, 5) AS trend, coalesce((SELECT string_agg(text, ',' ORDER BY text)
        FROM warned w WHERE w.session_id = f.session_id), '') AS warnings
    FROM fitted f WHERE f.session_id NOT IN (SELECT session_id FROM refused)""",
)
def usable_fits(spark, sf_dir):
    found = pace.usable_fits(fits(spark, sf_dir))
    return found.select(
        "session_id", F.round("trend", 5).alias("trend"), joined("warnings").alias("warnings")
    )


@query("g10_refused_fits", f"WITH RECURSIVE {REFUSED} SELECT session_id, refusals FROM refused")
def refused_fits(spark, sf_dir):
    """Refused fits with the reasons; only a fit of full rank has numbers to name."""
    found = pace.refused_fits(fits(spark, sf_dir))
    told = F.when(F.col("rank") < F.col("width"), "effects not identified").otherwise(joined("refusals"))
    return found.select("session_id", told.alias("refusals"))
