"""Hazards against lap-by-lap counting."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lapstream.functions import race
from lapstream.operators import hazard, history

HISTORY = (
    "race_id string, circuit string, total_laps long, sc_laps array<long>, vsc_laps array<long>, "
    "sc_starts array<long>, vsc_starts array<long>, starters long, retirements array<long>"
)


def bucket(lap, total):
    if lap <= 1:
        return "lap1"
    if total <= 1:
        return "early"
    done = (lap - 1) / (total - 1)
    return "early" if done < 0.25 else "mid" if done < 0.5 else "late" if done < 0.75 else "final"


def starts_of(active):
    return [x for x in active if x - 1 not in active]


def made(n=12):
    random.seed(2)
    races = []
    for i in range(n):
        total = random.choice([1, 2, 7, 20, 33])
        sc = sorted(random.sample(range(1, total + 1), min(total, random.randint(0, 4))))
        vsc = sorted(random.sample(range(1, total + 1), min(total, random.randint(0, 4))))
        gone = [random.randint(0, total + 2) for _ in range(random.randint(0, 4))]
        circuit = random.choice(["Spa", "Monaco", "Monte Carlo", " Miami Gardens", None])
        races.append((f"r{i}", circuit, total, sc, vsc, starts_of(sc), starts_of(vsc), random.choice([0, 5, 9]), gone))
    return races


ALIAS = {"Monte Carlo": "Monaco", "Miami Gardens": "Miami"}


def name(circuit):
    text = (circuit or "unknown").strip()
    return ALIAS.get(text, text)


def counted(races, kind):
    """Laps at risk and events per (circuit, bucket), lap by lap."""
    out = {}
    for _, circuit, total, sc, vsc, sc0, vsc0, _, _ in races:
        if total < 2:
            continue
        active = set(sc) if kind == "sc" else set(sc) | set(vsc)
        starts = set(sc0) if kind == "sc" else {x for x in set(sc0) | set(vsc0) if x - 1 not in active}
        for lap in range(1, total + 1):
            if lap in active and lap not in starts:
                continue
            cell = out.setdefault((name(circuit), bucket(lap, total)), [0, 0])
            cell[0] += 1
            cell[1] += lap in starts
    return out


def car_counted(races):
    out = {}
    for _, circuit, total, *_, starters, gone in races:
        if not starters or total < 2:
            continue
        stops = [min(x, total) for x in gone if x >= 1]
        spans = [(total, None)] * max(0, starters - len(stops)) + [(s, s) for s in stops]
        for last, stop in spans:
            for lap in range(1, last + 1):
                cell = out.setdefault((name(circuit), bucket(lap, total)), [0, 0])
                cell[0] += 1
                cell[1] += lap == stop
    return out


def cells(counts):
    rows = counts.where("exposure > 0").collect()
    return {(r["circuit"], r["bucket"]): [r["exposure"], r["events"]] for r in rows}


@pytest.fixture(scope="module")
def tables(spark):
    races = made()
    return races, hazard.from_history(spark.createDataFrame(races, HISTORY))


@pytest.mark.parametrize("kind", ["sc", "any"])
def test_exposure(tables, kind):
    races, t = tables
    got = hazard.neutralisation_counts(t["races"], t["starts"], t["active"], kind, "race_id")
    assert cells(got) == counted(races, kind)


def test_attrition_exposure(tables):
    races, t = tables
    got = hazard.attrition_counts(t["races"], t["retirements"], "race_id")
    assert cells(got) == car_counted(races)


def test_factors_and_window_probabilities(spark, tables):
    races, t = tables
    counts = counted(races, "any")
    got = hazard.neutralisation_counts(t["races"], t["starts"], t["active"], "any", "race_id").cache()
    base = {}
    for (_, b), (n, e) in counts.items():
        base.setdefault(b, [0, 0])
        base[b][0] += n
        base[b][1] += e
    rate = {b: e / n for b, (n, e) in base.items()}
    factor = {}
    for c in {c for c, _ in counts}:
        seen = sum(e for (k, _), (_, e) in counts.items() if k == c)
        want = sum(rate[b] * n for (k, b), (n, _) in counts.items() if k == c)
        factor[c] = (seen + 3) / (want + 3)
    found = {r["circuit"]: r["factor"] for r in hazard.circuit_factors(got, 3.0).collect()}
    assert found == pytest.approx(factor)

    def h(circuit, lap, total):
        return min(1.0, rate.get(bucket(lap, total), 0.0) * factor.get(name(circuit), 1.0))

    asked = [(c, a, b, t) for c in ("Spa", "Monte Carlo", "Nowhere") for t in (1, 2, 9, 30)
             for a, b in ((1, t), (0, 3), (2, 5), (t, t + 4), (5, 2))]
    df = spark.createDataFrame(asked, "circuit string, a long, b long, total_laps long").withColumn("id", F.monotonically_increasing_id())
    answers = hazard.with_curve(df, hazard.hazard_curves(got, 3.0)).select(
        "a", "b", "total_laps", "circuit",
        hazard.survival(F.col("a"), F.col("b"), F.col("total_laps")).alias("s"),
        hazard.expected_events(F.col("total_laps")).alias("e"),
        "known_circuit",
    ).collect()
    assert len(answers) == len(asked)
    for r in answers:
        laps = range(max(1, r["a"]), max(0, r["b"]) + 1)
        want = math.prod(1 - h(r["circuit"], x, r["total_laps"]) for x in laps)
        assert r["s"] == pytest.approx(want), r
        assert r["e"] == pytest.approx(sum(h(r["circuit"], x, r["total_laps"]) for x in range(1, r["total_laps"] + 1)))
        assert r["known_circuit"] == (r["circuit"] != "Nowhere")


def test_phase_laps_equal_counting(spark):
    rows = [(t, a, b) for t in range(1, 40) for a, b in ((1, t), (3, 7), (1, 1), (t, t + 3))]
    df = spark.createDataFrame(rows, "t long, a long, b long")
    counts = race.phase_laps(F.col("t"), F.col("b"), F.col("a"))
    for r in df.select("t", "a", "b", *[c.alias(n) for n, c in counts.items()]).collect():
        want = {n: 0 for n in race.BUCKETS}
        for lap in range(r["a"], r["b"] + 1):
            want[bucket(lap, r["t"])] += 1
        assert {n: r[n] for n in race.BUCKETS} == want, r


def test_no_exposure_no_model(spark):
    t = hazard.from_history(spark.createDataFrame([("r", "Spa", 1, [], [], [], [], 0, [])], HISTORY))
    counts = hazard.neutralisation_counts(t["races"], t["starts"], t["active"], "any", "race_id")
    assert hazard.hazard_summary(t["races"], counts).count() == 0
    assert hazard.attrition_summary(t["races"], t["retirements"], "race_id").count() == 0


def test_history_from_lap_tables(spark):
    observed = spark.createDataFrame(
        [("r", "A", 1, "1"), ("r", "A", 2, "14"), ("r", "A", 3, "4"), ("r", "B", 1, "1"), ("r", "B", None, "5"), ("r", "A", 5, "461")],
        "session_id string, driver string, lap long, status string",
    )
    results = spark.createDataFrame([("r", "A", "1"), ("r", "B", " r "), ("r", "C", "R")], "session_id string, driver string, classified string")
    dims = spark.createDataFrame([("r", "Spa")], "session_id string, circuit string")
    row = history.race_history(observed, results, dims).first()
    assert (row["total_laps"], row["starters"], row["retirements"]) == (5, 3, [1, 1])
    assert (row["sc_laps"], row["sc_starts"]) == ([2, 3, 5], [2, 5])
    assert (row["vsc_laps"], row["red_laps"]) == ([5], [])


def test_upsert_recollects_incomplete_records(spark):
    schema = "season long, round long, starters long, retirements array<long>, tag string"
    held = spark.createDataFrame([(2022, 1, 20, [], "old"), (2022, 2, None, [], "old")], schema)
    new = spark.createDataFrame([(2022, 1, 20, [], "new"), (2022, 2, 20, [], "new"), (2022, 3, 20, [], "new")], schema)
    merged = history.upsert_history(held, new).collect()
    assert [(r["round"], r["tag"]) for r in merged] == [(1, "old"), (2, "new"), (3, "new")]
    assert history.upsert_history(held.drop("starters"), new).count() == 3
