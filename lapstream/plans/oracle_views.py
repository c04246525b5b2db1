"""SQL twins of the stand-in tables, for the side-by-side check.

Each text is a chain of common table expressions over ``events``.
"""

FEED = """
feed AS (
  SELECT event_id AS seq, ts,
    CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS wk,
    user_id % 10 AS cohort,
    CAST(floor((day(ts) - 1) / 7) AS BIGINT) * 10 + user_id % 10 AS session_id,
    user_id AS driver, event_type AS topic, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""

LAPS = (
    FEED
    + """,
lap1 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, driver ORDER BY seq) AS lap,
    count(*) OVER (PARTITION BY session_id, driver) AS driver_laps,
    topic = 'purchase' AS entered_pit,
    coalesce(lag(topic = 'purchase') OVER (PARTITION BY session_id, driver ORDER BY seq), FALSE)
      AS exited_pit,
    CAST(coalesce(sum(CASE WHEN topic = 'purchase' THEN 1 ELSE 0 END)
      OVER (PARTITION BY session_id, driver ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stint
  FROM feed),
lap2 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, driver, stint ORDER BY seq)
      - CASE WHEN stint > 0 THEN 1 ELSE 0 END AS tyre_age,
    max(lap) OVER (PARTITION BY session_id) AS total_laps,
    row_number() OVER (PARTITION BY session_id, lap ORDER BY value DESC, driver) AS position
  FROM lap1),
laps AS (
  SELECT session_id, cohort AS circuit, driver, seq, lap, total_laps,
    CASE WHEN topic = 'view' AND k < 2 THEN NULL
      ELSE CAST(80 AS DOUBLE) + k / CAST(10 AS DOUBLE)
           + CASE WHEN value > 200 THEN CAST(60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END
      AS lap_time,
    entered_pit, exited_pit, stint, tyre_age,
    CASE WHEN k = 99 THEN 'UNKNOWN' WHEN (stint + driver) % 3 = 0 THEN 'SOFT'
      WHEN (stint + driver) % 3 = 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
    CASE WHEN topic = 'error' AND k < 5 THEN '4' WHEN topic = 'signup' AND k < 5 THEN '6'
      ELSE '1' END AS status,
    CASE WHEN topic = 'view' THEN NULL ELSE value / CAST(10 AS DOUBLE) END AS gap_s,
    value, k, lap = driver_laps AS is_last,
    lap = driver_laps AND topic = 'error' AND lap < total_laps AS retired, position
  FROM lap2)"""
)

RACES = (
    LAPS
    + """,
race AS (
  SELECT session_id, CAST(min(circuit) AS VARCHAR) AS circuit, max(total_laps) AS total_laps,
    count(DISTINCT driver) AS starters
  FROM laps GROUP BY session_id),
flag AS (
  SELECT session_id, lap, bool_or(status = '4') AS sc, bool_or(status = '6') AS vsc
  FROM laps GROUP BY session_id, lap),
sc_start AS (
  SELECT a.session_id, a.lap FROM flag a LEFT JOIN flag b
    ON a.session_id = b.session_id AND b.lap = a.lap - 1 AND b.sc WHERE a.sc AND b.lap IS NULL),
vsc_start AS (
  SELECT a.session_id, a.lap FROM flag a LEFT JOIN flag b
    ON a.session_id = b.session_id AND b.lap = a.lap - 1 AND b.vsc WHERE a.vsc AND b.lap IS NULL),
active AS (SELECT session_id, lap FROM flag WHERE sc OR vsc),
start AS (
  SELECT s.session_id, s.lap FROM
    (SELECT * FROM sc_start UNION SELECT * FROM vsc_start) s
    LEFT JOIN active b ON s.session_id = b.session_id AND b.lap = s.lap - 1
  WHERE b.lap IS NULL),
gone AS (SELECT session_id, driver, lap FROM laps WHERE retired)"""
)

PHASE = """CASE WHEN lap <= 1 THEN 'lap1' WHEN total_laps <= 1 THEN 'early'
  WHEN (lap - 1) / CAST(total_laps - 1 AS DOUBLE) < 0.25 THEN 'early'
  WHEN (lap - 1) / CAST(total_laps - 1 AS DOUBLE) < 0.50 THEN 'mid'
  WHEN (lap - 1) / CAST(total_laps - 1 AS DOUBLE) < 0.75 THEN 'late' ELSE 'final' END"""

# One row per race and lap: the plain way to count laps at risk.
RACE_LAPS = (
    RACES
    + f""",
grid AS (
  SELECT session_id, circuit, total_laps, starters, lap, {PHASE} AS bucket FROM (
    SELECT *, unnest(generate_series(1, total_laps)) AS lap FROM race WHERE total_laps >= 2)),
risk AS (
  SELECT g.*, CASE WHEN s.lap IS NULL THEN 0 ELSE 1 END AS event
  FROM grid g LEFT JOIN active a USING (session_id, lap) LEFT JOIN start s USING (session_id, lap)
  WHERE a.lap IS NULL OR s.lap IS NOT NULL),
base AS (
  SELECT bucket, count(*) AS exposure, sum(event) AS events,
    sum(event) / CAST(count(*) AS DOUBLE) AS hazard FROM risk GROUP BY bucket),
factor AS (
  SELECT circuit, (sum(event) + CAST(3 AS DOUBLE)) / (sum(hazard) + CAST(3 AS DOUBLE)) AS factor
  FROM risk JOIN base USING (bucket) GROUP BY circuit),
car AS (
  SELECT g.*, CASE WHEN r.lap = g.lap THEN 1 ELSE 0 END AS event
  FROM grid g JOIN (SELECT DISTINCT session_id, driver FROM laps) d USING (session_id)
  LEFT JOIN gone r ON r.session_id = d.session_id AND r.driver = d.driver
  WHERE r.lap IS NULL OR g.lap <= r.lap),
cbase AS (
  SELECT bucket, count(*) AS exposure, sum(event) AS events,
    sum(event) / CAST(count(*) AS DOUBLE) AS hazard FROM car GROUP BY bucket),
cfactor AS (
  SELECT circuit, (sum(event) + CAST(4 AS DOUBLE)) / (sum(hazard) + CAST(4 AS DOUBLE)) AS factor
  FROM car JOIN cbase USING (bucket) GROUP BY circuit),
hlap AS (
  SELECT g.session_id, g.circuit, g.total_laps, g.lap,
    least(CAST(1 AS DOUBLE), coalesce(b.hazard, 0) * coalesce(f.factor, 1)) AS h,
    least(CAST(1 AS DOUBLE), coalesce(c.hazard, 0) * coalesce(e.factor, 1)) AS ch
  FROM grid g LEFT JOIN base b USING (bucket) LEFT JOIN factor f USING (circuit)
    LEFT JOIN cbase c USING (bucket) LEFT JOIN cfactor e USING (circuit))"""
)

# Feed messages, already taken apart: what each field of each message says.
MSG = (
    FEED
    + """,
msg AS (
  SELECT CAST(session_id AS VARCHAR) AS session_id, seq, ts, CAST(driver AS VARCHAR) AS car, k,
    value, topic AS etype,
    CASE WHEN topic IN ('click', 'purchase') THEN 'TimingData' WHEN topic = 'view' THEN 'TimingAppData'
      WHEN topic = 'error' THEN 'TrackStatus' WHEN k % 4 = 0 THEN 'LapCount'
      WHEN k % 4 = 1 THEN 'WeatherData' WHEN k % 4 = 2 THEN 'DriverList' ELSE 'SessionInfo' END
      AS topic
  FROM feed),
timing AS (
  SELECT session_id, seq, car,
    CASE WHEN etype = 'click' AND k % 5 <> 4 AND k >= 3 THEN k % 20 + 1 END AS position,
    CASE WHEN etype = 'purchase' AND k % 3 <> 0 THEN k // 10 END AS laps_completed,
    CASE WHEN etype = 'click' AND k % 4 <> 0 THEN
      CASE WHEN k % 4 = 1 THEN '' ELSE '+' || CAST(value AS VARCHAR) END END AS gap,
    CASE WHEN etype = 'click' AND k % 3 = 0 THEN '1L' WHEN etype = 'click' AND k % 3 = 1
      THEN '+' || CAST(value AS VARCHAR) END AS ival,
    CASE WHEN etype = 'click' AND k % 10 = 7 THEN TRUE
      WHEN etype = 'click' AND k % 10 = 8 THEN FALSE END AS in_pit,
    CASE WHEN etype = 'click' AND k % 10 = 8 THEN TRUE
      WHEN etype = 'click' AND k % 10 = 9 THEN FALSE END AS pit_out,
    CASE WHEN etype = 'click' AND k = 50 THEN TRUE
      WHEN etype = 'click' AND k = 51 THEN FALSE END AS retired,
    etype = 'purchase' AS completes,
    CASE WHEN etype = 'purchase' AND k >= 5
      THEN 60 + k % 60 + k / CAST(1000 AS DOUBLE) END AS lap_time,
    CASE WHEN etype = 'purchase' AND k % 4 = 0 THEN 20 + k % 10 + CAST(0.5 AS DOUBLE) END AS s0,
    CASE WHEN etype = 'purchase' AND k % 4 = 1 THEN 20 + k % 10 + CAST(0.5 AS DOUBLE) END AS s1,
    CASE WHEN etype = 'purchase' AND k % 4 = 2 THEN 20 + k % 10 + CAST(0.5 AS DOUBLE) END AS s2
  FROM msg WHERE topic = 'TimingData'),
stint AS (
  SELECT session_id, seq, car, k // 34 AS stint,
    CASE k % 4 WHEN 1 THEN 'SOFT' WHEN 2 THEN 'HARD' END AS compound,
    CASE WHEN k % 2 = 0 THEN FALSE END AS is_new,
    CASE WHEN k % 5 <> 0 THEN k % 30 END AS total_laps
  FROM msg WHERE topic = 'TimingAppData'),
names AS (
  SELECT session_id, seq, car, CASE WHEN k >= 10 THEN 'T' || k END AS tla,
    CASE WHEN k % 8 <> 2 THEN 'Car ' || k END AS full_name, 'B' || k AS bname,
    'Team ' || k % 10 AS team
  FROM msg WHERE topic = 'DriverList'),
sess AS (
  SELECT session_id, seq,
    CASE WHEN topic = 'LapCount' AND k >= 8 THEN k END AS lap,
    CASE WHEN topic = 'LapCount' AND k % 8 = 0 THEN 70 END AS total_laps,
    CASE WHEN topic = 'TrackStatus' THEN
      CASE WHEN k % 9 = 8 THEN '0' ELSE CAST(k % 9 AS VARCHAR) END END AS status,
    CASE WHEN topic = 'WeatherData' AND k % 10 <> 1 THEN CAST(k % 10 - 1 AS DOUBLE) END AS air,
    CASE WHEN topic = 'WeatherData' AND k <= 50 THEN CAST(k AS DOUBLE) END AS track,
    CASE WHEN topic = 'WeatherData' AND k % 8 = 1 THEN TRUE
      WHEN topic = 'WeatherData' AND k % 16 = 5 THEN FALSE END AS rain,
    CASE WHEN topic = 'SessionInfo' THEN 'Race ' || k END AS name,
    CASE WHEN topic = 'SessionInfo' THEN 'Race' END AS type,
    CASE WHEN topic = 'SessionInfo' THEN 'L' || k END AS location,
    CASE WHEN topic = 'SessionInfo' AND k % 8 <> 3 THEN 'C' || k END AS short_name
  FROM msg WHERE topic IN ('LapCount', 'TrackStatus', 'WeatherData', 'SessionInfo'))"""
)


def last_of(column: str, order: str = "seq") -> str:
    """Latest non-NULL value of a column within a group."""
    return f"arg_max({column}, {order}) FILTER ({column} IS NOT NULL)"


def last_so_far(column: str, keys: str) -> str:
    return (
        f"last_value({column} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY seq"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


CAR_KEYS = "session_id, car"

# Final state per car.
CARS = (
    MSG
    + f""",
tstate AS (
  SELECT session_id, car, {last_of("position")} AS position,
    coalesce({last_of("laps_completed")}, 0) AS laps_completed,
    nullif({last_of("gap")}, '') AS gap_to_leader, nullif({last_of("ival")}, '') AS ival,
    {last_of("lap_time")} AS last_lap_time, {last_of("s0")} AS s0, {last_of("s1")} AS s1,
    {last_of("s2")} AS s2, coalesce({last_of("in_pit")}, FALSE) AS in_pit,
    coalesce({last_of("pit_out")}, FALSE) AS pit_out,
    coalesce({last_of("retired")}, FALSE) AS retired
  FROM timing GROUP BY session_id, car),
sstate AS (
  SELECT session_id, car, stint, coalesce({last_of("compound")}, 'UNKNOWN') AS compound,
    coalesce({last_of("is_new")}, TRUE) AS is_new, coalesce({last_of("total_laps")}, 0) AS total_laps
  FROM stint GROUP BY session_id, car, stint),
sall AS (
  SELECT t.session_id, t.car, i.stint, coalesce(s.compound, 'UNKNOWN') AS compound,
    coalesce(s.is_new, TRUE) AS is_new, coalesce(s.total_laps, 0) AS total_laps, top
  FROM (SELECT session_id, car, max(stint) AS top FROM sstate GROUP BY 1, 2) t
  JOIN (SELECT unnest([0, 1, 2]) AS stint) i ON i.stint <= t.top
  LEFT JOIN sstate s ON s.session_id = t.session_id AND s.car = t.car AND s.stint = i.stint),
nstate AS (
  SELECT session_id, car, {last_of("tla")} AS tla, {last_of("team")} AS team,
    coalesce({last_of("full_name")}, {last_of("bname")}) AS name
  FROM names GROUP BY session_id, car),
seen AS (
  SELECT session_id, car, min(seq) AS first_seen FROM (
    SELECT session_id, car, seq FROM timing UNION ALL SELECT session_id, car, seq FROM stint
    UNION ALL SELECT session_id, car, seq FROM names) GROUP BY 1, 2),
cars AS (
  SELECT e.session_id, e.car, e.first_seen, t.position, coalesce(n.tla, '') AS tla, n.name, n.team,
    coalesce(s.compound, 'UNKNOWN') AS compound, coalesce(s.total_laps, 0) AS tyre_age,
    t.gap_to_leader, t.ival, t.last_lap_time, coalesce(t.in_pit, FALSE) AS in_pit,
    coalesce(t.retired, FALSE) AS retired
  FROM seen e LEFT JOIN tstate t USING (session_id, car) LEFT JOIN nstate n USING (session_id, car)
    LEFT JOIN (SELECT * FROM sall WHERE stint = top) s USING (session_id, car))"""
)

# Completed laps, with every status found by an overlap join against the periods.
FEED_LAPS = (
    MSG
    + f""",
rowsall AS (
  SELECT session_id, car, seq, position, laps_completed, gap, ival, in_pit, pit_out, retired,
    completes, lap_time, NULL AS stint, NULL AS compound, NULL AS age, NULL AS tla, NULL AS team
  FROM timing
  UNION ALL SELECT session_id, car, seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL,
    stint, compound, total_laps, NULL, NULL FROM stint
  UNION ALL SELECT session_id, car, seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL,
    NULL, NULL, NULL, tla, team FROM names),
ctx AS (
  SELECT session_id, car, seq, completes, lap_time, laps_completed AS sent,
    {last_so_far("position", CAR_KEYS)} AS position,
    {last_so_far("laps_completed", CAR_KEYS)} AS laps_completed,
    {last_so_far("gap", CAR_KEYS)} AS gap, {last_so_far("ival", CAR_KEYS)} AS ival,
    coalesce({last_so_far("in_pit", CAR_KEYS)}, FALSE) AS in_pit,
    coalesce({last_so_far("pit_out", CAR_KEYS)}, FALSE) AS pit_out,
    coalesce({last_so_far("retired", CAR_KEYS)}, FALSE) AS retired,
    {last_so_far("tla", CAR_KEYS)} AS tla, {last_so_far("team", CAR_KEYS)} AS team,
    max(stint) OVER (PARTITION BY session_id, car ORDER BY seq) AS stint
  FROM rowsall),
num AS (
  SELECT * FROM (SELECT *, coalesce(sent, laps_completed, 0) - 1 AS lap FROM ctx WHERE completes)
  WHERE lap >= 1),
fresh AS (
  SELECT * FROM (SELECT *, lag(lap) OVER (PARTITION BY session_id, car ORDER BY seq) AS before
    FROM num) WHERE before IS NULL OR before <> lap),
acc AS (
  SELECT *, lag(seq) OVER (PARTITION BY session_id, car ORDER BY seq) AS prev_seq FROM fresh),
pits AS (
  SELECT a.session_id, a.car, a.seq, bool_or(b.in_pit) AS entered, bool_or(b.pit_out) AS exited
  FROM acc a JOIN ctx b ON a.session_id = b.session_id AND a.car = b.car AND b.seq <= a.seq
    AND b.seq >= coalesce(a.prev_seq, -1) GROUP BY 1, 2, 3),
chg AS (
  SELECT session_id, seq, status FROM (
    SELECT session_id, seq, status,
      coalesce(lag(status) OVER (PARTITION BY session_id ORDER BY seq), '0') AS was
    FROM sess WHERE status IS NOT NULL) WHERE status <> was),
spans AS (
  SELECT session_id, status, seq AS start_seq,
    lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS end_seq FROM chg),
spans0 AS (
  SELECT * FROM spans
  UNION ALL SELECT s.session_id, '0', -1, min(c.seq) FROM (SELECT DISTINCT session_id FROM msg) s
    LEFT JOIN chg c USING (session_id) GROUP BY s.session_id),
stat AS (
  SELECT a.session_id, a.car, a.seq, string_agg(DISTINCT s.status, ',' ORDER BY s.status) AS statuses
  FROM acc a JOIN spans0 s ON a.session_id = s.session_id AND s.start_seq <= a.seq
    AND (s.end_seq IS NULL OR s.end_seq > coalesce(a.prev_seq, a.seq)) GROUP BY 1, 2, 3),
tyre AS (
  SELECT a.session_id, a.car, a.seq,
    arg_max(s.compound, s.seq) FILTER (s.compound IS NOT NULL) AS compound,
    arg_max(s.total_laps, s.seq) FILTER (s.total_laps IS NOT NULL) AS age
  FROM acc a JOIN stint s ON a.session_id = s.session_id AND a.car = s.car AND s.seq <= a.seq
    AND s.stint = a.stint GROUP BY 1, 2, 3),
flaps AS (
  SELECT a.session_id, a.car AS driver, a.seq, a.lap, a.lap_time, coalesce(a.tla, '') AS tla,
    coalesce(a.team, '') AS team, coalesce(t.compound, 'UNKNOWN') AS compound,
    coalesce(t.age, 0) AS tyre_age, coalesce(a.stint, 0) AS stint, a.position,
    CASE WHEN a.ival LIKE '+%' THEN CAST(substr(a.ival, 2) AS DOUBLE) END AS gap_s,
    nullif(a.gap, '') AS gap_to_leader, s.statuses, p.entered AS entered_pit,
    p.exited AS exited_pit, a.retired
  FROM acc a LEFT JOIN pits p USING (session_id, car, seq) LEFT JOIN stat s
    USING (session_id, car, seq) LEFT JOIN tyre t USING (session_id, car, seq))"""
)

DRAWS = (
    LAPS
    + """,
draws AS (
  SELECT session_id, lap % 4 AS option_id, lap // 4 AS draw, driver,
    CAST(sum(CAST(round(coalesce(lap_time, 120) * 1000) AS BIGINT))
      OVER (PARTITION BY session_id, driver ORDER BY seq) AS BIGINT) / CAST(1000 AS DOUBLE) AS elapsed,
    retired, lap AS retired_on, position, total_laps
  FROM laps),
subj AS (
  SELECT session_id, min(driver) AS driver FROM laps GROUP BY session_id),
subject AS (
  SELECT s.session_id, s.driver, arg_max(l.position, l.lap) AS start_position
  FROM subj s JOIN laps l USING (session_id, driver) GROUP BY 1, 2),
board AS (
  SELECT d.session_id, option_id, d.driver, avg(CAST(position AS DOUBLE)) AS mean_position,
    avg(CAST(position <= 3 AS INT)) AS p_top3, avg(CAST(position <= 10 AS INT)) AS p_points,
    avg(CAST(position < start_position AS INT)) AS p_gain,
    avg(CAST(retired AS INT)) AS p_retire, count(*) AS n_sims
  FROM draws d JOIN subject USING (session_id, driver) GROUP BY 1, 2, 3),
dist AS (
  SELECT session_id, option_id, driver, position,
    count(*) / CAST(sum(count(*)) OVER (PARTITION BY session_id, option_id, driver) AS DOUBLE)
      AS probability
  FROM draws GROUP BY 1, 2, 3, 4)"""
)

PREDS = (
    LAPS
    + """,
preds AS (
  SELECT session_id, driver, avg(CAST(position <= 3 AS INT)) AS p_top3,
    avg(CAST(position <= 10 AS INT)) AS p_points, avg(CAST(position AS DOUBLE)) AS expected_position,
    arg_max(position, lap) AS position, max(lap) AS lap, max(total_laps) AS total_laps
  FROM laps WHERE lap * 2 <= total_laps GROUP BY 1, 2),
fin AS (
  SELECT session_id, driver, actual FROM (
    SELECT session_id, driver, bool_or(retired) AS gone, row_number() OVER (PARTITION BY session_id
      ORDER BY sum(CAST(round(value * 100) AS BIGINT)) DESC, driver) AS actual
    FROM laps GROUP BY 1, 2) WHERE NOT gone),
pair AS (
  SELECT p.*, actual, CASE WHEN actual <= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END AS t3,
    CASE WHEN actual <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END AS pt,
    CASE WHEN position <= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END AS h3,
    CASE WHEN position <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END AS hp
  FROM preds p JOIN fin USING (session_id, driver)),
card AS (
  SELECT s.session_id, count(actual) AS n, any_value(s.total) - count(actual) AS n_skipped,
    coalesce(avg(power(p_top3 - t3, 2)), 0) AS brier_top3,
    coalesce(avg(power(p_points - pt, 2)), 0) AS brier_points,
    coalesce(avg(power(h3 - t3, 2)), 0) AS baseline_top3,
    coalesce(avg(power(hp - pt, 2)), 0) AS baseline_points,
    coalesce(avg(abs(expected_position - actual)), 0) AS position_error,
    coalesce(avg(CAST(abs(position - actual) AS DOUBLE)), 0) AS baseline_position_error
  FROM (SELECT session_id, count(*) AS total FROM preds GROUP BY 1) s
    LEFT JOIN pair USING (session_id) GROUP BY s.session_id),
skilled AS (
  SELECT *, CASE WHEN baseline_top3 <= 0 THEN
      CASE WHEN brier_top3 <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
      ELSE 1 - brier_top3 / baseline_top3 END AS skill_top3,
    CASE WHEN baseline_points <= 0 THEN
      CASE WHEN brier_points <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
      ELSE 1 - brier_points / baseline_points END AS skill_points
  FROM card)"""
)
