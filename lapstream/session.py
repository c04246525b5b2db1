"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Rows a task may hold where each costs some 100 microseconds.
ROWS_PER_TASK = 1 << 17


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lapstream")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names it; Spark makes one folder per application in it.
    Where it is unset a scratch folder is made, but only in local mode: the disks of a
    cluster's executors are not shared, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder; call it at the end of a run."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never reused between runs."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders ``by`` column, and read it back.

    For results that are small against their inputs and used several times, such
    as the counts behind a fit. The files outlive a lost executor, and their known
    size lets the planner choose the join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out where it has too few splits for costly work per row.

    A single small file is one split, and per-row work on it would keep one core
    busy; a large file has far more rows than a task should hold. There are as many
    tasks as cores, or as many as the rows need at ``ROWS_PER_TASK``; rows are counted
    from the file footers. Inputs with enough splits are left alone: no shuffle is added
    to them. Rows are dealt by hash, which needs no sort, and alike in every run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // ROWS_PER_TASK))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *df.columns)
