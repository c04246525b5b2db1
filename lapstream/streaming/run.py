"""Starting and reading streams: catch-up runs, update sinks, state store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows a file of a written feed may hold, and files a micro-batch takes.
FILE_ROWS = 1 << 19
BATCH_FILES = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so its size is bound by disk and not by heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(df: DataFrame, order: str, batches: int = 1) -> DataFrame:
    """Deal rows to tasks that follow each other in ``order``: files for so many micro-batches at least."""
    files = max(batches * BATCH_FILES, -(-df.count() // FILE_ROWS))
    return df.repartitionByRange(files, order)


def write_in_order(df: DataFrame, path: str) -> None:
    """Write a table of :func:`in_order` for a file source, which takes files by their time of change.

    The tasks end in any order, so files are stamped in the order of their rows, a second apart.
    Then any number of files makes a micro-batch without a row coming before an earlier one.
    """
    df.write.parquet(path)
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files() -> list:
        found = [f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda f: int(f.getPath().getName().split("-")[1]))

    written = files()
    newest = max((f.getModificationTime() for f in written), default=0)
    for back, each in enumerate(reversed(written)):
        fs.setTimes(each.getPath(), newest - 1000 * back, -1)
    times = [f.getModificationTime() for f in files()]
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise RuntimeError(f"files below {path} cannot be stamped in order")


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet table; default is to catch up and stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def update_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write changed rows of an aggregate, each batch into its own folder.

    A batch that is retried overwrites its folder, so rows are never doubled.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each_batch(stream, write, checkpoint, mode="update", **trigger)


def each_batch(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    **trigger,
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of an update sink.

    A key has one row per batch it changed in; the window keeps one (group limit).
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return (
        spark.read.parquet(path)
        .withColumn("_back", F.row_number().over(newest))
        .where("_back = 1")
        .drop("_back", "batch")
    )
