"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC records; records are dealt to files by a hash of their id, ordered by id
within a file, and get the byte range they have there. A leaf of a file's tree is the
SHA-256 of a record; a node is the SHA-256 of the digests and byte ranges of up to ``FAN``
neighbours below it. The roots of the files are the leaves of one tree over the archive.

An audit compares two replicas from the top and goes down only below nodes that differ, so
what it joins shrinks to the damaged branches. Records at differing leaves are told apart
as corrupt, missing, extra, or moved (same bytes, other range).

Payloads are hashed where they are read and are not shuffled. A file's records are ordered
in one task without their bytes; ``per_file`` bounds them. NULL ids, urls and pages count
as empty text. Repeated rows are separate records. An empty table has no files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapstream.session import cut_lineage

FAN = 16
PER_FILE = 1024
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record. The tables have no fetch time, so the date is fixed."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
        F.lit(END),
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id and record."""
    return pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def file_count(found: DataFrame, per_file: int = PER_FILE) -> int:
    return -(-found.count() // per_file)


def layout(found: DataFrame, files: int) -> DataFrame:
    """page_id, file, place in the file, digest and byte range [start, stop) of every record."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    hashed = found.select(
        "page_id",
        (number.cast("bigint") % F.lit(max(files, 1))).alias("file"),
        F.sha2("record", 256).alias("digest"),
        F.octet_length("record").cast("bigint").alias("length"),
    )
    along = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "digest")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select(
        "page_id",
        "file",
        (F.row_number().over(along) - 1).cast("bigint").alias("node"),
        "digest",
        (F.sum("length").over(upto) - F.col("length")).alias("start"),
        F.sum("length").over(upto).alias("stop"),
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: a node over each run of ``FAN`` nodes of a file."""
    child = F.struct("node", "digest", "start", "stop")
    text = F.array_join(
        F.transform("below", lambda c: F.concat_ws(":", c["digest"], c["start"].cast("string"), c["stop"].cast("string"))),
        ",",
    )
    return (
        nodes.groupBy("file", F.expr(f"node div {FAN}").alias("node"))
        .agg(F.array_sort(F.collect_list(child)).alias("below"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("file", "node", F.sha2(text, 256).alias("digest"), "start", "stop")
    )


def height(most: int) -> int:
    """Levels above the leaves until one node holds ``most`` leaves."""
    levels = 0
    while most > 1:
        most = -(-most // FAN)
        levels += 1
    return levels


def levels_of(leaves: DataFrame, up: int, label: str) -> list[DataFrame]:
    found = [leaves]
    for _ in range(up):
        found.append(cut_lineage(parents(found[-1]), label))
    return found


def tree(placed: DataFrame, up: int, archive_up: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the files' trees, and of the archive's tree over their roots."""
    nodes = ["file", "node", "digest", "start", "stop"]
    inner = levels_of(placed.select(nodes), up, "warc-nodes")
    roots = inner[-1].select(F.lit(0).cast("bigint").alias("file"), F.col("file").alias("node"), "digest", "start", "stop")
    return inner, levels_of(roots, archive_up, "warc-archive")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places (file, node) where two levels do not agree."""
    both = a.select("file", "node", F.col("digest").alias("a")).join(
        b.select("file", "node", F.col("digest").alias("b")), ["file", "node"], "full"
    )
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


def below(level: DataFrame, damaged: DataFrame) -> DataFrame:
    """Nodes of a level whose parent is damaged."""
    up = damaged.select("file", F.col("node").alias("up"))
    return (
        level.withColumn("up", F.expr(f"node div {FAN}")).join(up, ["file", "up"], "left_semi").drop("up")
    )


def descend(a: list[DataFrame], b: list[DataFrame], top: DataFrame) -> DataFrame:
    """Damaged leaves below the damaged nodes ``top`` of the highest level."""
    damaged = cut_lineage(top, "warc-damaged")
    for level_a, level_b in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        damaged = cut_lineage(differing(below(level_a, damaged), below(level_b, damaged)), "warc-damaged")
    return damaged


def damaged_places(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places (file, node) of records at which two laid-out replicas differ."""
    most = max(x.agg(F.max("node")).first()[0] or 0 for x in (a, b)) + 1
    files = max(x.agg(F.max("file")).first()[0] or 0 for x in (a, b)) + 1
    (inner_a, over_a), (inner_b, over_b) = (tree(x, height(most), height(files)) for x in (a, b))
    bad_files = descend(over_a, over_b, differing(over_a[-1], over_b[-1])).select(F.col("node").alias("file"))
    tops = [x[-1].join(bad_files, "file", "left_semi") for x in (inner_a, inner_b)]
    return descend(inner_a, inner_b, differing(*tops))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of replica ``a`` and every extra one of ``b`` with its status.

    Columns page_id, file, start, length, digest, status: intact, corrupt, missing, moved
    or extra. Both replicas are written tables as :func:`layout` makes them.
    """
    places = damaged_places(a, b)
    nth = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("node"))
    ours, theirs = (x.join(places, ["file", "node"], "left_semi").withColumn("nth", nth) for x in (a, b))
    same = (
        F.col("x.file").eqNullSafe(F.col("y.file"))
        & F.col("x.page_id").eqNullSafe(F.col("y.page_id"))
        & (F.col("x.nth") == F.col("y.nth"))
    )
    status = (
        F.when(F.isnull("y.file"), "missing")
        .when(F.isnull("x.file"), "extra")
        .when(F.col("x.digest") != F.col("y.digest"), "corrupt")
        .otherwise("moved")
    )
    judged = cut_lineage(
        ours.alias("x")
        .join(theirs.alias("y"), same, "full")
        .select(
            *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("page_id", "file", "node", "start", "stop", "digest")],
            status.alias("status"),
        ),
        "warc-judged",
    )
    columns = ["page_id", "file", "start", (F.col("stop") - F.col("start")).alias("length"), "digest"]
    mine = judged.filter("status <> 'extra'").select("file", "node", "status")
    whole = a.join(mine, ["file", "node"], "left").select(
        *columns, F.coalesce("status", F.lit("intact")).alias("status")
    )
    return whole.unionByName(judged.filter("status = 'extra'").select(*columns, "status"))


def write_warc(found: DataFrame, files: int, path: str) -> None:
    """Write records as WARC files, one folder per file number, in the layout's order."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    (
        found.withColumn("file", number.cast("bigint") % F.lit(max(files, 1)))
        .withColumn("digest", F.sha2("record", 256))
        .repartition("file")
        .sortWithinPartitions("file", F.col("page_id").asc_nulls_last(), "digest")
        .select("file", F.expr(f"substring(record, 1, length(record) - {len(END)})").alias("value"))
        .write.partitionBy("file")
        .option("lineSep", END)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, file, place, digest and byte range of the records in written WARC files.

    Records are found by their Content-Length, and what cannot be read as a record counts
    as one record up to the end of the file.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re

        head = re.compile(rb"WARC/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n(?:[^\r\n]+\r\n)*\r\n")
        page = re.compile(rb"<urn:page:(-?\d+)>")
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data, at, rows = content.as_py(), 0, []
                while at < len(data):
                    found = head.match(data, at)
                    stop = min(len(data), found.end() + int(found[1]) + len(END)) if found else len(data)
                    named = page.search(data, at, found.end()) if found else None
                    digest = hashlib.sha256(data[at:stop]).hexdigest()
                    rows.append((int(named[1]) if named else None, file, len(rows), digest, at, stop))
                    at = stop
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["page_id", "file", "node", "digest", "start", "stop"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("bigint").alias("file"), "content")
    return named.mapInArrow(
        parse, "page_id bigint, file bigint, node bigint, digest string, start bigint, stop bigint"
    )
