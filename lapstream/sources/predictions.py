"""The prediction log: append-only JSON lines, one folder per session."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapstream.functions.text import session_slug

SCHEMA = (
    "circuit string, compound string, decisive boolean, driver string, "
    "expected_position double, horizon_lap bigint, id string, lap bigint, margin double, "
    "n_sims bigint, note string, p_gain double, p_points double, p_top3 double, "
    "pit_lap bigint, position bigint, recorded_at string, session string, tla string, "
    "total_laps bigint"
)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Add predictions to the log, keys of each line in alphabetical order."""
    slugged = predictions.withColumn("slug", session_slug(F.col("session")))
    columns = sorted(predictions.columns)
    slugged.select("slug", *columns).write.mode("append").partitionBy("slug").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All readable log lines; none where there is no log yet."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    # An unreadable line carries its own text and nothing else.
    parsed = F.from_json("value", f"{SCHEMA}, _corrupt_record string")
    opened = lines.where(F.trim("value") != "").select(parsed.alias("p")).select("p.*")
    return opened.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
