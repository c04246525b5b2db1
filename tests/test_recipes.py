"""Whole questions asked of a small recording, a history file and a log."""

from __future__ import annotations

import json
import random

import pytest

from lapstream.plans import recipes
from tests.test_feed import LINES, at, write


@pytest.fixture
def recording(tmp_path):
    return write(tmp_path, LINES)


@pytest.fixture(scope="module")
def race(tmp_path_factory):
    """Six cars over forty laps, tyres changed at different laps."""
    random.seed(4)
    lines = [["LapCount", {"CurrentLap": 1, "TotalLaps": 40}, at(0)], ["TrackStatus", {"Status": "1"}, at(0)]]
    wear = {"SOFT": 0.12, "MEDIUM": 0.08, "HARD": 0.05}
    for car in range(1, 7):
        lines.append(["DriverList", {str(car): {"Tla": f"C{car}"}}, at(0)])
    stint, age = {c: -1 for c in range(1, 7)}, {}
    for lap in range(1, 41):
        for car in range(1, 7):
            if stint[car] < 0 or (stint[car] < 2 and lap == (stint[car] + 1) * 11 + car):
                stint[car] += 1
                age[car] = 0
            age[car] += 1
            compound = ("SOFT", "MEDIUM", "HARD")[(stint[car] + car) % 3]
            tyre = {str(stint[car]): {"Compound": compound, "TotalLaps": age[car]}}
            lines.append(["TimingAppData", {"Lines": {str(car): {"Stints": tyre}}}, at(1)])
            time = 84 + 0.1 * car - 0.05 * lap + wear[compound] * age[car] + random.gauss(0, 0.02)
            line = {
                "NumberOfLaps": lap + 1, "LastLapTime": {"Value": f"1:{time - 60:06.3f}"},
                "Position": str(car), "GapToLeader": f"+{3.5 * (car - 1):.1f}" if car > 1 else "",
                "IntervalToPositionAhead": {"Value": "+3.5"},
            }
            lines.append(["TimingData", {"Lines": {str(car): line}}, at(1)])
        lines.append(["LapCount", {"CurrentLap": lap + 1}, at(2)])
    return write(tmp_path_factory.mktemp("race"), lines)


def test_topics(spark, recording):
    census, totals = recipes.topics(spark, recording)
    assert census.first()["topic"] == "TimingData"
    assert tuple(totals.first()) == (len(LINES), len({x[0] for x in LINES}))


def test_board(spark, recording):
    rows = recipes.board(spark, recording).collect()
    assert [(r["code"], r["tyre"], r["gap_to_leader"]) for r in rows] == [
        ("KIT", "SOF", "LAP 5"), ("LUX", "HAR", "+2.750"), ("MOR", "INT", "+8.000")
    ]
    assert recipes.board(spark, recording, limit=1).count() == 1


def test_lap_report(spark, race):
    report = recipes.lap_report(spark, race)
    totals = report["totals"].first()
    assert totals["total"] == 240 and totals["clean"] > 150
    fit = report["fits"].first()
    assert fit["trend"] == pytest.approx(-0.05, abs=0.02) and list(fit["refusals"]) == []
    fuel = report["fuel"].first()
    assert fuel["prior_sec_per_lap"] == pytest.approx(70 / 40 * 0.035)
    assert {r["code"] for r in report["by_compound"].collect()} == {"SOF", "MED", "HAR"}


def test_grid_at_a_lap_uses_what_was_known(spark, race):
    known = recipes.grid_at(spark, race, 35)
    grid = known["grid"].orderBy("place").collect()
    assert [r["tla"] for r in grid] == [f"C{i}" for i in range(1, 7)]
    assert [r["elapsed"] for r in grid] == pytest.approx([3.5 * i for i in range(6)])
    assert known["options"].count() == 12
    assert max(r["pit_lap"] for r in known["options"].collect()) == 40
    early = recipes.grid_at(spark, race, 8)
    assert early["grid"].count() == 0


def test_hazard_report(spark, tmp_path):
    races = [
        {"season": 2024, "round": i, "circuit": "Spa", "total_laps": 40, "sc_laps": [1, 2], "sc_starts": [1],
         "vsc_laps": [], "vsc_starts": [], "starters": 20, "retirements": [3]}
        for i in range(4)
    ]
    (tmp_path / "h.json").write_text(json.dumps(races))
    found = recipes.hazard_report(spark, str(tmp_path / "h.json"), circuit="Spa", total_laps=40)
    assert found["summary"].first()["n_events"] == 4
    assert {r["bucket"]: r["hazard"] for r in found["baseline"].collect()}["lap1"] == 1.0
    assert [r["span"] for r in found["risk"].orderBy("span").collect()] == [5, 10, 15]
    assert found["attrition"].first()["rate_per_car"] == pytest.approx(0.05)
    assert found["retirements"].first()["expected"] > 0


def test_score_log_of_several_sessions(spark, tmp_path):
    for name, order in (("one", "12"), ("two", "21")):
        lines = [["TimingData", {"Lines": {car: {"Position": str(i + 1)} for i, car in enumerate(order)}}, at(0)]]
        write(tmp_path, lines, f"{name}.txt")
    log = tmp_path / "log"
    log.mkdir()
    calls = [{"session": s, "driver": "1", "lap": 3, "position": 1, "p_top3": 1.0} for s in ("A", "B")]
    (log / "a.jsonl").write_text("\n".join(map(json.dumps, calls)))
    path = str(tmp_path / "*.txt")
    found = recipes.score_log(spark, str(log), path, {"A": "one", "B": "two"})["calls"]
    assert sorted(r["result"] for r in found.collect()) == ["P1", "P2"]
    with pytest.raises(ValueError, match="several sessions"):
        recipes.score_log(spark, str(log), path)


def test_score_log(spark, race, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    call = {"session": "R", "driver": "2", "lap": 10, "position": 5, "p_top3": 0.9, "p_points": 1.0, "expected_position": 2.5}
    lost = {**call, "driver": "99"}
    (log / "a.jsonl").write_text("\n".join([json.dumps(call), "{torn", "", json.dumps(lost)]))
    found = recipes.score_log(spark, str(log), race)
    card = found["card"].first()
    assert (card["n"], card["n_skipped"]) == (1, 1)
    assert card["brier_top3"] == pytest.approx(0.01) and card["position_error"] == 0.5
    assert sorted(r["result"] for r in found["calls"].collect()) == ["DNF", "P2"]
