"""Scoring rules, outcome aggregates and the prediction log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lapstream.functions import text
from lapstream.operators import clean, ledger, outcomes
from lapstream.sources import history, predictions
from lapstream.session import scratch_path

PREDS = "session_id string, driver string, position long, p_top3 double, p_points double, expected_position double"


def card_of(spark, preds, finish):
    p = spark.createDataFrame(preds, PREDS)
    f = spark.createDataFrame(finish, "session_id string, driver string, actual long")
    return ledger.scorecard(ledger.scored_pairs(p, f)).first(), ledger.scored_pairs(p, f)


def test_perfect_calls(spark):
    preds = [("s", str(i), 12 - i, 1.0 if i <= 3 else 0.0, 1.0 if i <= 10 else 0.0, float(i)) for i in range(1, 13)]
    card, _ = card_of(spark, preds, [("s", str(i), i) for i in range(1, 13)])
    assert (card["brier_top3"], card["brier_points"], card["position_error"]) == (0, 0, 0)
    assert card["skill_top3"] == 1.0 and card["beats_baseline"] and card["verdict"] == "beat"


def test_confidently_wrong_against_a_flawless_baseline(spark):
    card, _ = card_of(spark, [("s", "1", 1, 0.0, 0.0, 9.0)], [("s", "1", 1)])
    assert card["brier_top3"] == 1.0 and card["skill_top3"] == float("-inf")
    assert card["verdict"] == "too few" and list(card["caveats"]) == ["few scored: 1"]


def test_cars_without_a_finish_are_skipped(spark):
    card, _ = card_of(spark, [("s", "1", 1, 1.0, 1.0, 1.0), ("s", "2", 2, 0.5, 0.5, 2.0)], [("s", "1", 1)])
    assert (card["n"], card["n_skipped"]) == (1, 1)
    card, _ = card_of(spark, [("s", "2", 2, 0.5, 0.5, 2.0)], [("s", "1", 1)])
    assert (card["n"], card["verdict"], card["brier_top3"]) == (0, "nothing", 0.0)


def test_missing_fields_fall_back(spark):
    card, _ = card_of(spark, [("s", "1", None, None, None, None)], [("s", "1", 2)])
    assert (card["brier_top3"], card["position_error"], card["baseline_position_error"]) == (1.0, 0.0, 0.0)


def test_bands_keep_certain_calls(spark):
    preds = [("s", str(i), 1, p, 0.0, 1.0) for i, p in enumerate((0.0, 0.19, 0.2, 0.8, 1.0))]
    _, pairs = card_of(spark, preds, [("s", str(i), 1) for i in range(5)])
    found = {(r["low"], r["high"]): r["n"] for r in ledger.calibration(pairs).collect()}
    assert found == {(0.0, 0.2): 2, (0.2, 0.4): 1, (0.8, 1.0): 2}


@pytest.mark.parametrize("x", [0.5225, -0.5235, 0.0, 1.0, 0.0855, 0.07145, -2.3, 0.12345, 0.00049])
def test_skill_text_rounds_like_c(spark, x):
    got = spark.range(1).select(text.format_skill(F.lit(x))).first()[0]
    assert got == f"{x:+.1%}"


def test_skill_text_of_minus_infinity(spark):
    assert spark.range(1).select(text.format_skill(F.lit(float("-inf")))).first()[0] == "worse*"


DRAWS = "session_id string, option_id long, draw long, driver string, elapsed double, retired boolean, retired_on long, total_laps long"


def test_retired_cars_classify_behind_finishers(spark):
    rows = [
        ("s", 0, 0, "a", 100.0, False, 0, 50), ("s", 0, 0, "b", 99.0, False, 0, 50),
        ("s", 0, 0, "c", 1.0, True, 10, 50), ("s", 0, 0, "d", 2.0, True, 40, 50),
    ]
    found = outcomes.classify_draws(spark.createDataFrame(rows, DRAWS))
    assert {r["driver"]: r["classified"] for r in found.collect()} == {"b": 1, "a": 2, "d": 3, "c": 4}


def test_best_option_margin_and_ties(spark):
    board = spark.createDataFrame(
        [("s", 1, 4.0), ("s", 0, 4.0), ("s", 2, 4.5), ("t", 0, 3.0)],
        "session_id string, option_id long, mean_position double",
    )
    best = {r["session_id"]: r for r in outcomes.recommendation(board).collect()}
    assert (best["s"]["option_id"], best["s"]["margin"], best["s"]["decisive"]) == (0, 0.0, False)
    assert (best["t"]["margin"], best["t"]["decisive"]) == (0.0, False)


def test_core_is_the_fewest_positions(spark):
    rows = [("s", 0, "a", p, x) for p, x in ((1, 0.5), (2, 0.3), (3, 0.15), (9, 0.05))]
    probs = spark.createDataFrame(rows, "session_id string, option_id long, driver string, position long, probability double")
    core = outcomes.likely_core(probs).first()
    assert (core["low"], core["high"], core["mode"]) == (1, 3, 1)


LAP = (
    "session_id string, driver string, lap long, lap_time double, stint long, tyre_age long, "
    "interval double, track_statuses array<string>, entered_pit boolean, exited_pit boolean, retired boolean"
)


def lap(**changes):
    row = {
        "session_id": "s", "driver": "1", "lap": 10, "lap_time": 85.0, "stint": 0, "tyre_age": 10,
        "interval": 5.0, "track_statuses": ["1"], "entered_pit": False, "exited_pit": False, "retired": False,
    }
    return {**row, **changes}


CLEAN = [
    ({}, []),
    ({"lap_time": None}, ["NO_TIME"]),
    ({"lap": 1}, ["FIRST_LAP"]),
    ({"entered_pit": True}, ["IN_LAP"]),
    ({"exited_pit": True}, ["OUT_LAP"]),
    ({"stint": 1, "tyre_age": 0}, ["OUT_LAP"]),
    ({"stint": 1, "tyre_age": 1}, []),
    ({"stint": 0, "tyre_age": 0}, []),
    ({"track_statuses": ["1", "4"]}, ["NEUTRALISED"]),
    ({"track_statuses": ["2", "7"]}, []),
    ({"retired": True}, ["RETIRED"]),
    ({"interval": 1.9}, ["TRAFFIC"]),
    ({"interval": 2.0}, []),
    ({"interval": None}, []),
    ({"lap_time": 85.0 * 1.5}, ["IMPLAUSIBLE"]),
    ({"lap": 1, "interval": 0.5, "entered_pit": True}, ["FIRST_LAP", "IN_LAP", "TRAFFIC"]),
]


def test_every_reason(spark):
    rows = [lap(driver=str(i), **c) for i, (c, _) in enumerate(CLEAN)]
    found = clean.classify_laps(spark.createDataFrame(rows, LAP)).collect()
    got = {int(r["driver"]): sorted(r["reasons"]) for r in found}
    assert got == {i: want for i, (_, want) in enumerate(CLEAN)}


def test_switches_and_thresholds(spark):
    laps = spark.createDataFrame([lap(lap=1, interval=1.0), lap(driver="2", interval=3.0)], LAP)
    kept = clean.classify_laps(laps, exclude_first_lap=False, exclude_traffic=False)
    assert clean.clean_laps(kept).count() == 2
    assert clean.clean_laps(clean.classify_laps(laps, traffic_seconds=4.0)).count() == 0


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert predictions.read_predictions(spark, path).count() == 0
    rows = spark.createDataFrame([("Race 1", "44", 10), ("Race 2", "1", 12)], "session string, driver string, lap long")
    predictions.append_predictions(rows, path)
    predictions.append_predictions(rows.limit(1), path)
    found = predictions.read_predictions(spark, path)
    assert found.count() == 3 and found.where("driver = '44'").count() == 2
    import glob

    line = open(glob.glob(f"{path}/slug=race-1/*.json")[0]).readline()
    assert line.index('"driver"') < line.index('"lap"') < line.index('"session"')


def test_history_array_file(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"season": 2024, "round": 1, "sc_laps": [1, 2]}, {"season": 2024, "round": 2}]')
    rows = history.load_history(spark, str(tmp_path / "h.json")).orderBy("round").collect()
    assert rows[0]["sc_laps"] == [1, 2] and rows[1]["sc_laps"] is None


def test_prediction_rows(spark):
    best = spark.createDataFrame(
        [("Race", "Spa", 40, 44, "44", "HAM", 3, 43, "SOFT", 2.5, 0.2, True, 0.6, 0.9, 0.3, 100)],
        "session string, circuit string, lap long, total_laps long, driver string, tla string, position long, pit_lap long, "
        "option_compound string, expected_position double, margin double, decisive boolean, p_top3 double, p_points double, p_gain double, n_sims long",
    )
    row = ledger.prediction_rows(best).first()
    assert (row["horizon_lap"], row["compound"], len(row["id"])) == (44, "SOF", 12)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
