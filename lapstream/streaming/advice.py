"""Advice refreshed while laps come in: fits on what is known, or a refusal.

A fit needs sums only, so sums are what a stream keeps. A batch adds those of its new clean
laps to the cells they fall in. The best lap of a session may fall, which makes slower laps
that counted so far implausible; only then are kept laps read again, those of the sessions
that lose one, and their cells are summed anew. Sums are never subtracted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapstream.operators import clean, pace

# Least seconds between refreshes.
REFRESH = "8 seconds"
TOO_FEW = "not enough clean laps"
#: Every so many batches the whole state is written, and reads start from there.
SNAPSHOT = 16

KEYS = ("session_id",)
STINT = ("session_id", "driver", "compound", "stint")
COUNT = ("session_id", "compound", "lap")
STINT_SUMS = {**dict.fromkeys(pace.SUMS, "sum"), "max_lap": "max"}
COUNT_SUMS = {"n": "sum", "first_seen": "min"}


def _rows(reached: DataFrame, fits: DataFrame) -> DataFrame:
    """Advice of sessions (session_id, lap, clean_laps), given their fits."""
    joined = reached.join(fits.select(*KEYS, "trend", "residual_std", "refusals"), list(KEYS), "left")
    refused = F.when(F.col("refusals").isNull(), F.array(F.lit(TOO_FEW))).otherwise(F.col("refusals"))
    return joined.select(
        *KEYS, "lap", "clean_laps", "trend", "residual_std", refused.alias("refused"),
        (F.size(refused) == 0).alias("usable"),
    )


def advice(laps: DataFrame) -> DataFrame:
    """One row per session: lap reached, fit if usable, reasons if not."""
    classified = clean.classify_laps(laps)
    reached = classified.groupBy(*KEYS).agg(
        F.max("lap").alias("lap"), F.sum((F.size("reasons") == 0).cast("bigint")).alias("clean_laps")
    )
    return _rows(reached, pace.fit_pace(clean.clean_laps(classified)))


def _held(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """What batches before this one wrote, from the last snapshot on."""
    if before == 0:
        return spark.createDataFrame([], _batched(schema))
    first = (before - 1) // SNAPSHOT * SNAPSHOT
    rows = spark.read.schema(_batched(schema)).parquet(path)
    return rows.where((F.col("batch") >= first) & (F.col("batch") < before))


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("_v")).select(*keys, "_v.*")


def _kept(rows: DataFrame, old: DataFrame, keys: Sequence[str], path: str, batch: int) -> DataFrame:
    """Write the rows that changed, or all there are; give the newest of all."""
    whole = rows
    if batch % SNAPSHOT == 0:
        whole = rows.unionByName(old.join(rows.select(*keys), list(keys), "left_anti"))
    whole.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return _newest(_held(rows.sparkSession, path, rows.schema, batch + 1), keys)


def _batched(schema: T.StructType) -> T.StructType:
    """The columns, all of which may be NULL in a file, and the folder's batch."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema]).add("batch", T.IntegerType())


def _cells(fresh: DataFrame, old: DataFrame, redone: DataFrame | None, keys: Sequence[str], sums: dict) -> DataFrame:
    """Cells that change: sums of the new laps on top of the old ones. Cells of sessions that
    are summed anew (``redone`` has theirs) start from nothing, and may end at it."""
    keys = list(keys)
    total = [F.call_function(how, F.col(s)).alias(s) for s, how in sums.items()]
    if redone is None:
        before = old.join(fresh.select(*keys), keys, "left_semi")
        return before.unionByName(fresh).groupBy(*keys).agg(*total)
    sessions = redone.select(*KEYS).distinct()
    others = fresh.join(sessions, list(KEYS), "left_anti")
    before = old.join(others.select(*keys), keys, "left_semi")
    emptied = old.join(sessions, list(KEYS), "left_semi").withColumn("n", F.lit(0).cast(old.schema["n"].dataType))
    emptied = emptied.join(redone.select(*keys), keys, "left_anti")
    parts = (before, others, redone, emptied)
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*total)


def refresher(laps_path: str, advice_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps clean laps and their sums, and adds advice once per lap.

    Use with ``foreachBatch`` and a processing-time trigger of ``REFRESH``. A batch reads
    what earlier ones wrote and writes folders of its own, so a retry rewrites them. Only
    sessions that got to a further lap are fitted again, from their sums.

    NULL times, repeated laps and laps that come late are laps as in :func:`advice`; a batch
    without rows changes nothing. ``laps_path`` holds the laps and the state.
    """
    kept, stints, counts, sessions = (f"{laps_path}/{x}" for x in ("clean", "stints", "counts", "sessions"))

    def write(fresh: DataFrame, batch: int) -> None:
        spark = fresh.sparkSession
        fresh = fresh.persist()
        held: list[DataFrame] = []
        try:
            _write(spark, fresh, batch, held)
        finally:
            for each in (*held, fresh):
                each.unpersist()

    def _write(spark: SparkSession, fresh: DataFrame, batch: int, held: list[DataFrame]) -> None:
        def keep(rows: DataFrame) -> DataFrame:
            held.append(rows.persist())
            return held[-1]

        kind = fresh.schema["session_id"].dataType
        schema = T.StructType().add("session_id", kind).add("lap", fresh.schema["lap"].dataType)
        schema = schema.add("best", T.DoubleType()).add("clean_laps", T.LongType())
        old = _newest(_held(spark, sessions, schema, batch), KEYS)
        now = fresh.groupBy(*KEYS).agg(F.max("lap").alias("new_lap")).join(clean.session_best(fresh), list(KEYS))
        was = old.select(*KEYS, F.col("lap").alias("old_lap"), F.col("best").alias("was"), F.col("clean_laps").alias("before"))
        joined = now.join(was, list(KEYS), "left").select(
            *KEYS, F.greatest("new_lap", "old_lap").alias("lap"), F.least("best", "was").alias("best"), "was",
            F.coalesce("before", F.lit(0).cast("bigint")).alias("before"),
            (F.col("old_lap").isNull() | (F.col("new_lap") > F.col("old_lap"))).alias("further"),
        )
        state = keep(joined)

        usable = keep(clean.clean_laps(clean.classify_laps(fresh, KEYS, state)))
        usable.write.mode("overwrite").parquet(f"{kept}/batch={batch}")
        known = spark.read.schema(_batched(usable.schema)).parquet(kept).where(F.col("batch") <= batch)

        limit = F.col("best") * clean.OUTLIER_RATIO
        fell = state.where(F.col("was").isNull() & F.col("best").isNotNull() | (F.col("best") < F.col("was")))
        lowest = fell.where("before > 0").agg(F.min(limit)).first()[0]
        lost = redone = None
        if lowest is not None:
            # The lowest limit as a literal reaches the scan, which skips files without slow laps.
            slow = known.where((F.col("batch") < batch) & (F.col("lap_time") > lowest))
            late = F.col("was").isNull() | (F.col("lap_time") <= F.col("was") * clean.OUTLIER_RATIO)
            lost = slow.join(fell.select(*KEYS, "best", "was"), list(KEYS)).where((F.col("lap_time") > limit) & late)
            lost = keep(lost.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lost")))
            if not lost.isEmpty():
                again = known.join(lost.join(state, list(KEYS)).select(*KEYS, "best"), list(KEYS))
                redone = keep(pace.usable_laps(again.where(F.col("best").isNull() | (F.col("lap_time") <= limit))))

        added = usable.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("added"))
        reached = state.join(added, list(KEYS), "left")
        reached = reached.withColumn("lost", F.lit(0)) if lost is None else reached.join(lost, list(KEYS), "left")
        gained = F.coalesce("added", F.lit(0)) - F.coalesce("lost", F.lit(0))
        reached = keep(reached.withColumn("clean_laps", F.col("before") + gained))
        _kept(reached.select(*KEYS, "lap", "best", "clean_laps"), old, KEYS, sessions, batch)

        found = []
        for path, keys, sums, cells in (
            (stints, STINT, STINT_SUMS, lambda laps: pace.stint_sums(laps, KEYS)),
            (counts, COUNT, COUNT_SUMS, lambda laps: pace.lap_counts(laps, KEYS)),
        ):
            new = cells(pace.usable_laps(usable))
            before = _newest(_held(spark, path, new.schema, batch), keys)
            changed = _cells(new, before, None if redone is None else cells(redone), keys, sums).select(*new.columns)
            found.append(_kept(changed, before, keys, path, batch).where("n > 0"))
        further = keep(reached.where("further").select(*KEYS, "lap", "clean_laps"))
        mine = [keep(cells.join(further.select(*KEYS), list(KEYS), "left_semi")) for cells in found]
        _rows(further, pace.fit_sums(*mine, KEYS)).write.mode("overwrite").parquet(f"{advice_path}/batch={batch}")

    return write
