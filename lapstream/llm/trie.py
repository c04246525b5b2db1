"""Prefix trie of conversations: what they share turn by turn, and what sharing saves.

Every conversation is rebuilt first: it takes over the first turns of the conversation that
opens its block of ``BLOCK`` ids, then goes on with its own (``rebuilt``). A node is a
distinct sequence of first turns, named by a 128-bit digest made from running sums over
(place, turn), so that long conversations are digested in pieces.

Node table. Conversations are cut into stretches of ``STRETCH`` places, and stretches dealt
to shards by hash, so a shard has about ``SHARD_ROWS`` rows whatever the conversations hold.
A shard lists its distinct digests and gives each a slot of a minimal perfect hash
(``SlotTable``); a slot keeps its digest, and every lookup is verified against it. Counts are
scattered into flat arrays by slot; the partial nodes of all shards are then summed.

Totals over subtrees are linear in the nodes. A node's own share is put down once, in the
stretch of its smallest member, and each shard sums it upwards through its array of parent
slots, deepest places first. What lies below a stretch comes from a sum over the later
stretches of that conversation. The shards' sums of a node add up to its total, so no task
ever needs a whole subtree, a hot first turn or a whole long conversation.

The ids that end at a node are hashed in order, over runs joined beforehand, as a stream.

Turns go by ``turn`` with NULL first; of equal turns by the hash of their role and text, so
the order is fixed, and equal rows count as turns of their own. NULL role or text is empty.
Rows without ``conv_id`` belong to no conversation and are left out. Remainders of negative
ids are negative, as in SQL. An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.llm.common import word_count
from lapstream.operators.scan import running
from lapstream.session import cut_lineage

BLOCK = 20
HEADS = 4
STRETCH = 1 << 12
SHARD_ROWS = 1 << 16
RUN_IDS = 1 << 13
SUMS = ("p0", "p1", "p2", "p3")


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys, with the keys kept for verification.

    Level by level, keys are hashed into a field; those alone in their place stay, the rest
    go on to the next level. A key's slot is its rank among the places taken.
    """

    ROOM = 1.5

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros_like(keys)
        self.levels: list[tuple[np.ndarray, int]] = []
        rest, taken = keys, 0
        while len(rest):
            place = self.place(rest, len(self.levels), max(2, int(self.ROOM * len(rest))))
            held = np.bincount(place, minlength=max(2, int(self.ROOM * len(rest)))) == 1
            rank = np.where(held, np.cumsum(held) - 1, -1)
            self.levels.append((rank, taken))
            alone = held[place]
            self.keys[taken + rank[place[alone]]] = rest[alone]
            taken += int(alone.sum())
            rest = rest[~alone]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys[:, 0] ^ (keys[:, 1] + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table does not hold."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (rank, start) in enumerate(self.levels):
            here = rank[self.place(keys[open_], level, len(rank))]
            hit = here >= 0
            found[open_[hit]] = start + here[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        known = found >= 0
        known[known] = (self.keys[found[known]] == keys[known]).all(axis=1)
        return np.where(known, found, -1)


def keys_of(table: pa.Table, *names: str) -> np.ndarray:
    columns = [table.column(n).to_numpy().astype(np.int64).view(np.uint64) for n in names]
    return np.stack(columns, axis=1)


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    sorted_ = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    return sorted_[new]


# turns --------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn digest and words of every turn, in written form.

    Rows are sorted across the cluster and counted within a task; the rows of earlier tasks
    are added per (task, conversation), so a conversation may be of any length.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("said"),
        word_count(text).alias("words"),
    )
    turns = cut_lineage(turns.withColumn("row", F.monotonically_increasing_id()), "trie-turns")
    by = ["conv_id", "turn", "said", "row"]
    ordered = turns.repartitionByRange(*by).sortWithinPartitions(*by)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.ones(len(conv), dtype=bool)
            first[1:] = conv[1:] != conv[:-1]
            starts = np.flatnonzero(first)
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
            if conv[0] == last:
                at[: starts[1] if len(starts) > 1 else len(conv)] += count
            last, count = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(np.full(len(conv), task, dtype=np.int32)),
                    pa.array(at),
                    batch.column("said"),
                    batch.column("words"),
                ],
                ["conv_id", "task", "at", "said", "words"],
            )

    kind = "conv_id bigint, task int, at bigint, said string, words bigint"
    return cut_lineage(ordered.mapInArrow(number, kind), "trie-numbered")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, place, said, words), and conv_id and
    length of every rebuilt conversation."""
    rows = turn_rows(conversations)
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = (
        rows.groupBy("conv_id", "task")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    known = cut_lineage(held, "trie-held")
    convs = known.groupBy("conv_id").agg(F.sum("n").alias("n"))
    head = (
        rows.join(known.filter(f"conv_id % {BLOCK} = 0 and ahead < {HEADS}"), ["conv_id", "task"])
        .select("conv_id", (F.col("at") + F.col("ahead")).alias("place"), "said", "words")
        .filter(F.col("place") < HEADS)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "said", "words"))).alias("head"))
    )
    wanted = convs.select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"),
    )
    based = wanted.join(head.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "n", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")).alias("taken")
    )
    plan = cut_lineage(
        based.select("*", F.size("taken").cast("bigint").alias("k")), "trie-plan"
    )
    moved = known.join(plan.select("conv_id", "h", "k"), "conv_id")
    own = (
        rows.join(moved.select("conv_id", "task", "ahead", "h", "k"), ["conv_id", "task"])
        .filter(F.col("at") + F.col("ahead") > F.col("h"))
        .select("conv_id", (F.col("at") + F.col("ahead") - F.col("h") + F.col("k")).alias("place"), "said", "words")
    )
    lent = plan.select("conv_id", F.inline("taken")).select("conv_id", "place", "said", "words")
    lengths = plan.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("k")).alias("length"))
    return lent.unionByName(own), lengths


def occurrences(turns: DataFrame, seed: int) -> DataFrame:
    """Every place of every conversation with the digests of its node and of the parent."""
    mixed = [F.xxhash64(F.lit(seed), F.lit(i), F.col("place"), F.col("said")) for i in range(2)]
    parts = [F.shiftrightunsigned(m, 32) for m in mixed] + [m.bitwiseAND(0xFFFFFFFF) for m in mixed]
    named = dict(zip(SUMS, (parts[0], parts[2], parts[1], parts[3]), strict=True))
    summed = running(turns, ["conv_id"], "place", sums=named, span=STRETCH)
    own = [F.col(s) - named[s] for s in SUMS]

    def digest(place: Column, values: list[Column]) -> list[Column]:
        return [F.xxhash64(F.lit(i), place, *values) for i in range(2)]

    here = digest(F.col("place"), [F.col(s) for s in SUMS])
    above = digest(F.col("place") - 1, own)
    return summed.select(
        "conv_id",
        "place",
        F.col("said").substr(1, 32).alias("turn"),
        "words",
        *[c.alias(n) for c, n in zip(here + above, ("k0", "k1", "u0", "u1"), strict=True)],
    )


# shards -------------------------------------------------------------------------


def sharded(rows: DataFrame, count: int) -> DataFrame:
    """Deal stretches of conversations to shards of about ``SHARD_ROWS`` rows."""
    shards = max(1, -(-count // SHARD_ROWS))
    return rows.withColumn("shard", F.expr(f"pmod(xxhash64(conv_id, (place - 1) div {STRETCH}), {shards})"))


def partial_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of every shard: members and smallest member, scattered by slot."""

    def count(table: pa.Table) -> pa.Table:
        keys = keys_of(table, "k0", "k1")
        slots = SlotTable(distinct_keys(keys))
        at = slots.slots(keys)
        size = len(slots.keys)
        least = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(least, at, table.column("conv_id").to_numpy())
        first = np.full(size, len(at))
        np.minimum.at(first, at, np.arange(len(at)))
        of_first = {n: table.column(n).take(pa.array(first)) for n in ("place", "turn", "words", "u0", "u1")}
        same = np.ones(size, dtype=bool)
        turn = table.column("turn").combine_chunks().dictionary_encode().indices.to_numpy()
        for values in (turn, *(table.column(n).to_numpy() for n in ("place", "u0", "u1"))):
            np.logical_and.at(same, at, values == values[first[at]])
        return pa.table(
            {
                "k0": slots.keys[:, 0].view(np.int64),
                "k1": slots.keys[:, 1].view(np.int64),
                "n": np.bincount(at, minlength=size),
                "least": least,
                "same": same,
                **of_first,
            }
        )

    return rows.groupBy("shard").applyInArrow(
        count,
        "k0 bigint, k1 bigint, n bigint, least bigint, same boolean, place bigint, turn string, words bigint,"
        " u0 bigint, u1 bigint",
    )


def summed_up(place: np.ndarray, parent: np.ndarray, *totals: np.ndarray) -> None:
    """Add every slot's totals to its parent's, deepest places of the stretch first."""
    deep = (place - 1) % STRETCH
    order = np.argsort(-deep, kind="stable")
    cuts = np.flatnonzero(np.diff(deep[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        for total in totals:
            np.add.at(total, parent[level], total[level])


def partial_totals(rows: DataFrame) -> DataFrame:
    """Leaves and saved words below every slot of every shard."""

    def total(table: pa.Table) -> pa.Table:
        keys = keys_of(table, "k0", "k1")
        slots = SlotTable(distinct_keys(keys))
        at = slots.slots(keys)
        size = len(slots.keys)
        leaves, saved = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        np.add.at(leaves, at, table.column("leaves").to_numpy())
        np.add.at(saved, at, table.column("saved").to_numpy())
        place = np.zeros(size, dtype=np.int64)
        place[at] = table.column("place").to_numpy()
        parent = np.full(size, -1, dtype=np.int64)
        parent[at] = slots.slots(keys_of(table, "u0", "u1"))
        # A stretch hands its sum on by the sums over later stretches, not by slots.
        parent[(place - 1) % STRETCH == 0] = -1
        summed_up(place, parent, leaves, saved)
        return pa.table(
            {
                "k0": slots.keys[:, 0].view(np.int64),
                "k1": slots.keys[:, 1].view(np.int64),
                "leaves": leaves,
                "saved": saved,
            }
        )

    return rows.groupBy("shard").applyInArrow(total, "k0 bigint, k1 bigint, leaves bigint, saved bigint")


def ends(last: DataFrame) -> DataFrame:
    """SHA-256 over the ids (k0, k1, conv_id) that end at each node, in numeric order."""
    by = ["k0", "k1", "conv_id"]
    ordered = last.repartitionByRange(*by).sortWithinPartitions(*by)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, key, held = TaskContext.get().partitionId(), 0, None, []
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            if held:
                out.append((*key, task, number, ",".join(held)))
                number, held = number + 1, []

        def batch_out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k0", "k1", "task", "number", "ids"]
            )

        for batch in batches:
            for k0, k1, conv in zip(*(batch.column(c).to_pylist() for c in by), strict=True):
                if (k0, k1) != key or len(held) >= RUN_IDS:
                    close()
                    key = (k0, k1)
                held.append(str(conv))
            if out:
                yield batch_out()
        close()
        if out:
            yield batch_out()

    runs = ordered.mapInArrow(join, "k0 bigint, k1 bigint, task int, number bigint, ids string")
    by_node = runs.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "task", "number")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row(found: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*found, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k0", "k1", "ends_sha256"]
            )

        for batch in batches:
            found = []
            for k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "ids")), strict=True):
                if (k0, k1) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (k0, k1), hashlib.sha256(ids.encode())
            if found:
                yield row(found)
        if key is not None:
            yield row([(*key, state.hexdigest())])

    return by_node.mapInArrow(digest, "k0 bigint, k1 bigint, ends_sha256 string")


# trie ---------------------------------------------------------------------------


def node_table(turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Occurrences, nodes below the root, and the number of occurrences. A digest that
    stands for two sequences is found by comparing, and another seed is taken."""
    seed = 0
    while True:
        rows = cut_lineage(occurrences(turns, seed), "trie-rows")
        count = rows.count()
        parts = partial_nodes(sharded(rows, count))
        same = F.min("same")
        for c in ("place", "turn", "u0", "u1"):
            same = same & (F.min(c) == F.max(c))
        merged = parts.groupBy("k0", "k1").agg(
            F.sum("n").alias("n_convs"),
            F.min("least").alias("conv_id"),
            same.alias("same"),
            *[F.min(c).alias(c) for c in ("place", "words", "u0", "u1")],
        )
        nodes = cut_lineage(merged, "trie-nodes")
        if nodes.filter("not same").isEmpty():
            return rows, nodes, count
        seed += 1


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations)
    turns, lengths = cut_lineage(turns, "trie-rebuilt"), cut_lineage(lengths, "trie-lengths")
    rows, nodes, count = node_table(turns)
    children = (
        nodes.groupBy(F.col("u0").alias("k0"), F.col("u1").alias("k1"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.min("place").alias("below"))
        .filter("below > 1")
        .drop("below")
    )
    nodes = cut_lineage(
        nodes.join(children, ["k0", "k1"], "left").select(
            "*",
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
            F.isnull("n_children").cast("bigint").alias("leaves"),
        ).drop("words", "same"),
        "trie-known",
    )
    own = nodes.select("conv_id", "place", "saved", "leaves")
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    below = (
        own.groupBy("conv_id", F.expr(f"(place - 1) div {STRETCH}").alias("stretch"))
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        .select(
            "conv_id",
            # The sums of the stretches after this one are put down at the end of the one before it.
            (F.col("stretch") * STRETCH).alias("place"),
            *[(F.col(c) + F.coalesce(F.sum(c).over(later), F.lit(0))).alias(c) for c in ("saved", "leaves")],
        )
        .filter("place > 0")
    )
    # A conversation owns the end of its path, so stretches above the first it owns have nothing of
    # their own: each of them hands on the same sum.
    spread = below.groupBy("conv_id").agg(F.min(F.struct("place", "saved", "leaves")).alias("m")).select(
        "conv_id",
        F.explode(F.sequence(F.lit(STRETCH), F.col("m.place"), F.lit(STRETCH))).alias("place"),
        F.col("m.saved").alias("saved"),
        F.col("m.leaves").alias("leaves"),
    )
    inner = below.join(spread.select("conv_id", "place"), ["conv_id", "place"], "left_anti")
    shares = own.unionByName(spread).unionByName(inner).groupBy("conv_id", "place").agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    held = rows.join(shares, ["conv_id", "place"], "left").select(
        *["conv_id", "place", "k0", "k1", "u0", "u1"],
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("saved", "leaves")],
    )
    totals = partial_totals(sharded(held, count)).groupBy("k0", "k1").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    finished = (
        rows.select("conv_id", F.col("place").alias("length"), "k0", "k1")
        .join(lengths, ["conv_id", "length"])
        .select("k0", "k1", "conv_id")
        .unionByName(
            lengths.filter("length = 0").select(
                F.lit(0).cast("bigint").alias("k0"), F.lit(0).cast("bigint").alias("k1"), "conv_id"
            )
        )
    )
    ended = cut_lineage(ends(finished), "trie-ends")
    spark = conversations.sparkSession
    first, n_convs = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    n_first, n_leaves, saved = nodes.agg(F.count_if(F.col("place") == 1), F.sum("leaves"), F.sum("saved")).first()
    of_root = {"k0": 0, "k1": 0, "conv_id": first, "depth": 0, "parent_conv_id": None, "n_convs": n_convs}
    of_root |= {"n_children": n_first, "n_leaves": n_leaves or 1, "saved_tokens": saved or 0}
    top = spark.range(1 if n_convs else 0).select(*[F.lit(v).cast("bigint").alias(n) for n, v in of_root.items()])
    parents = nodes.filter("leaves = 0").select(
        F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("conv_id").alias("above")
    )
    inside = (
        nodes.join(totals, ["k0", "k1"], "left")
        .join(parents, ["u0", "u1"], "left")
        .select(
            "k0",
            "k1",
            "conv_id",
            F.col("place").alias("depth"),
            F.when(F.col("place") == 1, F.lit(first)).otherwise(F.col("above")).cast("bigint").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            "saved_tokens",
        )
    )
    return (
        inside.unionByName(top)
        .join(ended, ["k0", "k1"], "left")
        .select(
            *["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"],
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
