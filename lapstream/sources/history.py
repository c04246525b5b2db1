"""Race-history files: one JSON array of race records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "season bigint, round bigint, event string, circuit string, total_laps bigint, "
    "sc_laps array<bigint>, vsc_laps array<bigint>, red_laps array<bigint>, starters bigint, "
    "retirements array<bigint>, sc_starts array<bigint>, vsc_starts array<bigint>, "
    "red_starts array<bigint>"
)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or many files; fields a file lacks are NULL."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)
