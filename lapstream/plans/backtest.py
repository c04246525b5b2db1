"""Backtest: what would have been said at a series of laps, each from what was known then.

All laps of all sessions go through one plan, keyed by (session, as-of lap). Lap
extraction only looks back, so laps are extracted once and nothing is folded again
from the start. Nor are laps copied per wanted lap: what was known only grows and the
session best only falls, so a lap counts over a run of wanted laps (:func:`lap_spans`).
Laps are summed per run; only those sums are dealt to the wanted laps of their run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.operators import clean, grid, ledger, outcomes, pace
from lapstream.operators.laps import as_of_lap, lap_cutoffs
from lapstream.operators.scan import last_states
from lapstream.session import cut_lineage

# Laps a backtest asks about.
WANTED = (16, 24, 32, 40, 48)
KEYS = ("session_id", "as_of_lap")


def known_laps(laps: DataFrame, lap_counts: DataFrame, wanted: Sequence[int] = WANTED) -> DataFrame:
    """Clean laps as known at each wanted lap; the session best is as of then too."""
    known = as_of_lap(laps, lap_cutoffs(lap_counts, list(wanted)))
    return clean.clean_laps(clean.classify_laps(known, KEYS))


def lap_spans(laps: DataFrame, lap_counts: DataFrame, wanted: Sequence[int] = WANTED) -> DataFrame:
    """Laps that are clean at some wanted lap, once each: the run ``since`` to before ``until``
    of places among the sorted wanted laps at which they are known and clean.

    A lap enters with the first cutoff at or after it, and leaves where the best known by
    then makes it implausible. A session's reached laps come before those it never got to.
    """
    asked = lap_cutoffs(lap_counts, sorted(set(wanted))).where("reached")
    cuts = asked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("places"), F.array_compact(F.collect_list("cutoff")).alias("cutoffs")
    )
    passed = F.filter("cutoffs", lambda cutoff: cutoff < F.col("seq"))
    dated = laps.join(cuts, "session_id").withColumn("since", F.size(passed)).where("since < places")
    dated = cut_lineage(dated.drop("cutoffs"), "dated")
    firsts = clean.session_best(dated, ("session_id", "places", "since")).groupBy("session_id", "places").agg(
        F.collect_list(F.struct("since", "best")).alias("firsts")
    )

    def best_at(place):
        known = F.filter("firsts", lambda f: f["since"] <= place)
        return F.array_min(F.transform(known, lambda f: f["best"]))

    bests = F.transform(F.sequence(F.lit(0), F.col("places").cast("int") - 1), best_at)
    flags = clean.reason_flags()
    del flags["IMPLAUSIBLE"]
    kept = dated.drop("places").join(firsts.select("session_id", bests.alias("bests")), "session_id")
    for flag in flags.values():
        kept = kept.where(~flag)
    slow = F.filter("bests", lambda best: F.col("lap_time") > best * clean.OUTLIER_RATIO)
    return kept.withColumn("until", F.size("bests") - F.size(slow)).where("since < until").drop("bests")


def over_laps(cells: DataFrame, wanted: Sequence[int] = WANTED) -> DataFrame:
    """A row of sums per run, dealt to ``as_of_lap`` of each wanted lap in it."""
    laps = F.array(*[F.lit(x).cast("bigint") for x in sorted(set(wanted))])
    place = F.explode(F.sequence("since", F.col("until") - 1))
    dealt = cells.withColumn("place", place).withColumn("as_of_lap", F.get(laps, F.col("place")))
    return dealt.drop("since", "until", "place")


def fits_as_of(laps: DataFrame, lap_counts: DataFrame, wanted: Sequence[int] = WANTED) -> DataFrame:
    usable = cut_lineage(pace.usable_laps(lap_spans(laps, lap_counts, wanted)), "spans")
    run = ["session_id", "since", "until"]
    stints = over_laps(pace.stint_sums(usable, run), wanted).groupBy(*KEYS, "driver", "compound", "stint").agg(
        *[F.sum(s).alias(s) for s in pace.SUMS], F.max("max_lap").alias("max_lap")
    )
    counts = over_laps(pace.lap_counts(usable, run), wanted).groupBy(*KEYS, "compound", "lap").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen")
    )
    return pace.fit_sums(cut_lineage(stints, "stint-sums"), counts, KEYS)


def cars_as_of(
    deltas: DataFrame, lap_counts: DataFrame, fields: Sequence[str], wanted: Sequence[int] = WANTED
) -> DataFrame:
    """Latest car fields as known at each wanted lap."""
    known = as_of_lap(deltas, lap_cutoffs(lap_counts, list(wanted)))
    return last_states(known, (*KEYS, "car"), "seq", {f: F.col(f) for f in fields})


def predictions(
    fits: DataFrame,
    subjects: DataFrame,
    draws: DataFrame,
    horizon: int = ledger.HORIZON_LAPS,
) -> DataFrame:
    """Prediction rows of every usable fit, from supplied draws.

    ``subjects``: keys, driver, start_position, session, circuit, tla, total_laps.
    ``draws``: keys, option_id, draw, driver, position, retired. Options are those
    of :func:`grid.candidate_options`.
    """
    keys = list(KEYS)
    usable = pace.usable_fits(fits).select(*keys)
    asked = subjects.join(usable, keys).withColumn("lap", F.col("as_of_lap"))
    options = grid.candidate_options(asked)
    wanted = draws.select(*keys, "option_id", "driver", "position")
    mine = wanted.join(options, [*keys, "option_id", "driver"])
    about = [
        "session", "circuit", "lap", "total_laps", "tla", "start_position", "pit_lap",
        "option_compound",
    ]
    position = F.col("position")
    board = mine.groupBy(*keys, "option_id", "driver", *about).agg(
        F.avg(position.cast("double")).alias("mean_position"),
        F.avg((position <= outcomes.TOP).cast("double")).alias("p_top3"),
        F.avg((position <= outcomes.POINTS).cast("double")).alias("p_points"),
        F.avg((position < F.col("start_position")).cast("double")).alias("p_gain"),
        F.count(F.lit(1)).alias("n_sims"),
    )
    best = outcomes.recommendation(board, [*keys, "driver"])
    named = best.withColumnsRenamed(
        {"mean_position": "expected_position", "start_position": "position"}
    )
    return ledger.prediction_rows(named, horizon)
