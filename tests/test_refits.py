"""Fits that go on from sums: per batch of new laps, and per wanted lap of a backtest."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lapstream.operators import clean, pace
from lapstream.plans import backtest
from lapstream.streaming import advice

SCHEMA = (
    "session_id string, driver string, seq long, lap long, lap_time double, compound string, stint long, "
    "tyre_age long, entered_pit boolean, exited_pit boolean, retired boolean, interval double, track_statuses array<string>"
)
DRIVERS = "abcde"


def session_laps(name, n_laps, seed, slow_start=0):
    """Laps of five cars in seq order; the first ``slow_start`` laps take twice as long."""
    draw = random.Random(seed)
    rows, seq = [], 0
    for lap in range(1, n_laps + 1):
        for place, driver in enumerate(DRIVERS):
            seq += 1
            stint = int(lap > 6 + place)
            age = lap - (6 + place) * stint
            compound = ("SOFT", "HARD", "MEDIUM")[(place + stint) % 3]
            time = 90 + place * 0.3 + 0.05 * age - 0.02 * lap + draw.gauss(0, 0.1)
            time *= 2 if lap <= slow_start else draw.choice([1] * 15 + [1.35, 1.6])
            if draw.random() < 0.03:
                time = None
            gap = draw.choice([None, 1.0, 3.0, 3.0, 3.0])
            rows.append((name, driver, seq, lap, time, compound, stint, age, False, stint == 1 and age == 1, False, gap, ["1"]))
    return rows


@pytest.fixture(scope="module")
def laps(spark):
    rows = session_laps("even", 16, 1) + session_laps("late", 16, 2, slow_start=7) + session_laps("short", 2, 3)
    return spark.createDataFrame(rows, SCHEMA)


def told(rows):
    def near(x):
        return None if x is None else round(x, 6)

    return sorted(
        ((r.session_id, r.lap, r.clean_laps, near(r.trend), near(r.residual_std), tuple(r.refused), r.usable) for r in rows),
        key=str,
    )


def test_advice_per_batch_is_that_of_all_laps_so_far(spark, laps, tmp_path, monkeypatch):
    monkeypatch.setattr(advice, "SNAPSHOT", 2)
    write = advice.refresher(str(tmp_path / "laps"), str(tmp_path / "advice"))
    reached, fell, clean_before = {}, 0, 0
    for batch, low in enumerate(range(0, 80, 27)):
        fresh = laps.where((F.col("seq") > low) & (F.col("seq") <= low + 27))
        write(fresh, batch)
        if batch == 2:
            # A batch that is tried again overwrites what it left.
            write(fresh, batch)
        known = laps.where(F.col("seq") <= low + 27)
        came = {r.session_id for r in fresh.select("session_id").distinct().collect()}
        want = [r for r in advice.advice(known).collect() if r.session_id in came and r.lap > reached.get(r.session_id, 0)]
        reached |= {r.session_id: r.lap for r in want}
        got = spark.read.parquet(str(tmp_path / "advice")).where(F.col("batch") == batch).collect()
        assert told(got) == told(want)
        fell += any(r.session_id == "late" and 0 < r.clean_laps < clean_before for r in want)
        clean_before = max(r.clean_laps for r in want if r.session_id == "late")
    assert reached == {"even": 16, "late": 16, "short": 2}
    assert fell


def test_an_empty_batch_changes_nothing(spark, laps, tmp_path):
    write = advice.refresher(str(tmp_path / "laps"), str(tmp_path / "advice"))
    write(laps.limit(0), 0)
    write(laps.where("session_id = 'even'"), 1)
    write(laps.limit(0), 2)
    found = spark.read.parquet(str(tmp_path / "advice")).collect()
    assert [(r.session_id, r.lap, r.batch) for r in found] == [("even", 16, 1)]


def test_fits_per_wanted_lap_equal_fits_of_copied_laps(laps):
    wanted = (12, 3, 8, 14, 99)
    counts = laps.select("session_id", "seq", "lap")
    columns = [*backtest.KEYS, "n_laps", "n_stints", "reference", "rank", "width", "max_lap"]
    numbers = ["residual_std", "phase_spread"]
    want = pace.fit_pace(backtest.known_laps(laps, counts, wanted), backtest.KEYS).collect()
    got = backtest.fits_as_of(laps, counts, wanted).collect()

    def shown(rows):
        return sorted([tuple(r[c] for c in columns) + tuple(round(r[c], 6) for c in numbers) for r in rows], key=str)

    assert shown(got) == shown(want)
    assert {(r.session_id, r.as_of_lap) for r in got} >= {("even", 8), ("even", 14)}


def test_a_lap_is_kept_once_however_many_laps_are_wanted(laps):
    counts = laps.select("session_id", "seq", "lap")
    spans = backtest.lap_spans(laps, counts, tuple(range(2, 17)))
    assert spans.groupBy("session_id", "seq").count().where("count > 1").isEmpty()
    known = backtest.known_laps(laps, counts, tuple(range(2, 17)))
    dealt = backtest.over_laps(spans, tuple(range(2, 17)))
    keys = ["session_id", "as_of_lap", "seq"]
    assert sorted(map(tuple, dealt.select(*keys).collect())) == sorted(map(tuple, known.select(*keys).collect()))
    # Laps that counted until a faster one came.
    assert spans.where("session_id = 'late' and lap <= 7 and since < until").count() > 0
    assert clean.clean_laps(clean.classify_laps(laps)).where("session_id = 'late' and lap <= 7").isEmpty()
