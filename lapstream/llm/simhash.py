"""SimHash near-dedup over a hierarchical index in Gray order.

Fingerprints that differ in at most ``radius`` bits are linked. The bits are cut into
``radius + 1`` blocks, of which a linked pair shares at least one; for each block a copy
of the distinct fingerprints is rotated until that block leads. Each copy is sorted by
Gray rank across the cluster, and runs of ``LEAF`` neighbours become leaves. A leaf, and
every node above it, keeps the bits on which all below agree as a mask and a value.

Search descends from pairs of top nodes. A pair of groups goes on only if the agreed bits
differ in at most ``radius`` places and in none of the leading block, so whole groups drop
out before a fingerprint is compared. Leaf pairs that remain are compared in vectorised
code; each sends on a spanning forest of its links, not all pairs. The levels are joins,
so no task holds more than two leaves at a time and no index is sent around whole.

Components are found by alternating large-star and small-star steps over written tables.

NULL and empty texts, and texts of white space, have fingerprint zero and are linked like
any other. Repeated rows share their fingerprint. An empty table gives an empty result. A
component whose ids are all NULL has a NULL id; otherwise NULL ids are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.llm.common import content_key
from lapstream.session import cut_lineage

BITS = 64
LEAF = 512
FAN = 16
TOP = 64
SHINGLES_AT_ONCE = 1 << 14


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; A-Z in lower case, repeats count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - width + 1)
    begin, end = starts[:count].tolist(), ends[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, count, SHINGLES_AT_ONCE):
        high = min(count, low + SHINGLES_AT_ONCE)
        hashes = [digest(joined[a:b], seed) for a, b in zip(begin[low:high], end[low:high], strict=True)]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint of a text column as a signed long."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        found = (fingerprint_of(t, width) for t in texts)
        return pd.Series([f - (1 << BITS) if f >> (BITS - 1) else f for f in found], dtype="int64")

    return run(text)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each of ``radius + 1`` blocks."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(code: Column, by: int) -> Column:
    if by == 0:
        return code
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, BITS - by))


def gray_rank(code: Column) -> Column:
    """Place in the Gray sequence, as a signed long that sorts in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << (BITS - 1))))


def leaves(codes: DataFrame, radius: int, leaf: int = LEAF) -> DataFrame:
    """Runs of neighbours in Gray order: side, task, run, mask, value, codes."""
    copies = [
        F.struct(F.lit(side).alias("side"), rotated(F.col("code"), at).alias("code"))
        for side, (at, _) in enumerate(blocks(radius))
    ]
    ordered = (
        codes.select(F.explode(F.array(*copies)).alias("c"))
        .select("c.side", "c.code", gray_rank(F.col("c.code")).alias("rank"))
        .repartitionByRange("side", "rank")
        .sortWithinPartitions("side", "rank")
        .select("side", "code")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = TaskContext.get().partitionId(), 0
        kept_side: np.ndarray = np.zeros(0, dtype=np.int32)
        kept_code: np.ndarray = np.zeros(0, dtype=np.int64)

        def groups(final: bool) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal kept_side, kept_code
            at = 0
            while at < len(kept_code):
                end = at + int(np.searchsorted(kept_side[at:], kept_side[at], side="right"))
                if end == len(kept_code) and not final and end - at < leaf:
                    break
                stop = min(end, at + leaf)
                yield int(kept_side[at]), kept_code[at:stop]
                at = stop
            kept_side, kept_code = kept_side[at:], kept_code[at:]

        def out(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            nonlocal run
            columns: dict[str, list] = {k: [] for k in ("side", "task", "run", "mask", "value", "codes")}
            for side, part in found:
                every, some = np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)
                mask = ~(every ^ some)
                row = (side, task, run, int(mask), int(every & mask), part)
                for name, value in zip(columns, row, strict=True):
                    columns[name].append(value)
                run += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, list(columns))

        for batch in batches:
            kept_side = np.concatenate([kept_side, batch.column("side").to_numpy(zero_copy_only=False)])
            kept_code = np.concatenate([kept_code, batch.column("code").to_numpy(zero_copy_only=False)])
            if found := list(groups(False)):
                yield out(found)
        if found := list(groups(True)):
            yield out(found)

    return ordered.mapInArrow(cut, "side int, task int, run bigint, mask bigint, value bigint, codes array<bigint>")


def numbered(found: DataFrame) -> DataFrame:
    """Number leaves along the order: task by task, run by run."""
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        found.groupBy("task")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return found.join(offsets, "task").select(
        "side", (F.col("start") + F.col("run")).alias("node"), "mask", "value", "codes"
    )


def node_levels(found: DataFrame, fan: int = FAN, top: int = TOP) -> list[DataFrame]:
    """Tables of nodes from the leaves up: side, node, mask, value. The last has at most
    ``top`` node numbers."""
    levels = [found.select("side", "node", "mask", "value")]
    highest = found.agg(F.max("node")).first()[0] or 0
    while highest >= top:
        below = levels[-1]
        every, some = F.expr("bit_and(value)"), F.expr("bit_or(value)")
        grouped = below.groupBy("side", F.expr(f"node div {fan}").alias("node")).agg(
            F.expr("bit_and(mask)").alias("m"), every.alias("every"), some.alias("some")
        )
        mask = F.col("m").bitwiseAND(F.bitwise_not(F.col("every").bitwiseXOR(F.col("some"))))
        levels.append(
            cut_lineage(
                grouped.select("side", "node", mask.alias("mask"), F.col("every").bitwiseAND(mask).alias("value")),
                "simhash-nodes",
            )
        )
        highest //= fan
    return levels


def may_link(radius: int, widths: list[int] | None = None) -> Column:
    """Whether two groups (mask, value and mask_b, value_b) can hold a linked pair. The
    leading bits of each side are its block, or ``widths`` bits."""
    differ = (
        F.col("value").bitwiseXOR(F.col("value_b")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_b"))
    )
    leading = F.lit(None)
    for side, width in enumerate(widths or [width for _, width in blocks(radius)]):
        leading = F.when(F.col("side") == side, F.shiftrightunsigned(differ, BITS - width)).otherwise(leading)
    return (F.bit_count(differ) <= radius) & (leading == 0)


def leaf_pairs(
    levels: list[DataFrame], radius: int, fan: int = FAN, widths: list[int] | None = None
) -> DataFrame:
    """Pairs of leaves (side, node, node_b) that pass on every level."""
    top = levels[-1]
    other = top.select("side", *[F.col(c).alias(f"{c}_b") for c in ("node", "mask", "value")])
    pairs = top.join(other, "side").filter((F.col("node") <= F.col("node_b")) & may_link(radius, widths))
    for below in reversed(levels[:-1]):
        child = below.withColumn("parent", F.expr(f"node div {fan}"))
        first = child.select("side", F.col("parent").alias("up"), "node", "mask", "value")
        second = child.select(
            "side", F.col("parent").alias("up_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "mask", "value")]
        )
        pairs = (
            pairs.select("side", F.col("node").alias("up"), F.col("node_b").alias("up_b"), "mask_b", "value_b")
            .join(first, ["side", "up"])
            .filter(may_link(radius, widths))
            .select("side", "node", "mask", "value", "up_b")
            .join(second, ["side", "up_b"])
            .filter((F.col("node") <= F.col("node_b")) & may_link(radius, widths))
        )
        pairs = cut_lineage(
            pairs.select("side", "node", "mask", "value", "node_b", "mask_b", "value_b"), "simhash-pairs"
        )
    return pairs.select("side", "node", "node_b")


def forest(a: np.ndarray, b: np.ndarray, side: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (code, least code reached), of the links between two leaves."""
    _, width = blocks(radius)[side]
    differ = a[:, None] ^ b[None, :]
    linked = (np.bitwise_count(differ) <= radius) & (differ >> np.uint64(BITS - width) == 0) & (differ != 0)
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return a[:0], a[:0]
    linked = linked[np.ix_(rows, columns)]
    none = np.uint64(2**64 - 1)
    low_a, low_b = a[rows], b[columns]
    while True:
        next_b = np.minimum(low_b, np.where(linked, low_a[:, None], none).min(axis=0))
        next_a = np.minimum(low_a, np.where(linked, next_b[None, :], none).min(axis=1))
        if (next_a == low_a).all() and (next_b == low_b).all():
            break
        low_a, low_b = next_a, next_b
    code, least = np.concatenate([a[rows], b[columns]]), np.concatenate([low_a, low_b])
    return code[code != least], least[code != least]


def links(codes: DataFrame, radius: int = 2, leaf: int = LEAF, fan: int = FAN, top: int = TOP) -> DataFrame:
    """Links (u, v) whose components are those of all fingerprints (column code, distinct)
    within ``radius`` bits of each other."""
    found = cut_lineage(numbered(cut_lineage(leaves(codes, radius, leaf), "simhash-runs")), "simhash-leaves")
    pairs = leaf_pairs(node_levels(found, fan, top), radius, fan)
    left = found.select("side", "node", F.col("codes").alias("a"))
    right = found.select("side", F.col("node").alias("node_b"), F.col("codes").alias("b"))
    turns = [at for at, _ in blocks(radius)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, a, b in zip(
                batch.column("side").to_pylist(), batch.column("a"), batch.column("b"), strict=True
            ):
                a, b = (np.array(x.values).view(np.uint64) for x in (a, b))
                ends = forest(a, b, side, radius)
                if len(ends[0]):
                    by = np.uint64(turns[side])
                    back = [(e >> by) | (e << (np.uint64(BITS) - by)) if by else e for e in ends]
                    yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in back], ["u", "v"])

    return (
        pairs.join(left, ["side", "node"])
        .join(right, ["side", "node_b"])
        .select("side", "a", "b")
        .mapInArrow(compare, "u bigint, v bigint")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with a link: the least node of its component."""
    edges = cut_lineage(edges.filter("u <> v").select("u", "v"), "simhash-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        down = down.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            floor.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(small.filter("u <> v").distinct(), "simhash-edges")
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    return edges.select("u", F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    )


def near_copies(docs: DataFrame, width: int = 3, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id, root and content of every document.

    ``root`` is a fingerprint that names the component, with or without ids.
    """
    rows = cut_lineage(
        docs.select(
            "doc_id", content_key(F.col("text")).alias("content"), fingerprint(F.col("text"), width).alias("code")
        ),
        "simhash-rows",
    )
    codes = cut_lineage(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-codes")
    joined = cut_lineage(components(links(codes.select("code"), radius, leaf)), "simhash-components")
    lowest = (
        joined.join(codes, joined["u"] == codes["code"]).groupBy("root").agg(F.min("least").alias("component_id"))
    )
    linked = joined.join(lowest, "root").select(F.col("u").alias("code"), "root", "component_id")
    known = codes.join(linked, "code", "left").select(
        "code",
        F.coalesce("root", "code").alias("root"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    return rows.join(known, "code").select(
        "doc_id", F.col("code").alias("fingerprint"), "component_id", "root", "content"
    )


def verdict_of(found: DataFrame) -> DataFrame:
    """Keys whose rows go so that one document of each component stays: the one with the
    component's id, of several with that id the least content key, of equal rows one."""
    ordered = F.struct(F.isnull("doc_id"), "doc_id", "content")
    best = found.groupBy("root").agg(F.min(ordered).alias("best"))
    keys = found.groupBy("root", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    is_best = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.content") == F.col("content"))
    judged = keys.join(best, "root").select("doc_id", "content", "n", is_best.alias("keep"))
    return judged.filter("not keep or n > 1").select("doc_id", "content", "keep")
