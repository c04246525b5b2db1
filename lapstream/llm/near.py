"""Near copies: documents whose sets of five-word shingles have a Jaccard likeness of 0.8.

Rows whose words are equal, but for A-Z in lower case and white space, are one node. A node
has a SimHash fingerprint and a sketch of ``SKETCH`` bits, one of each min-wise draw from
its shingles. Candidates are found in the index of ``simhash``: ``VIEWS`` copies of all
nodes, in each of which ``LEAD`` other bits of the fingerprint lead, sorted in Gray order.
A candidate pair shares the leading bits of some view and differs in at most ``RADIUS``
fingerprint bits and ``SKETCH_RADIUS`` sketch bits. Fingerprints are over three words, as
near copies differ in fewer bits of those than over five.

Families. Candidates join nodes to families: leaves by themselves first, then pairs of
leaves, a few views at a time (``TURNS_AT``). A pair of leaves sends on a spanning forest of
candidates between families that are not joined yet, so a large group of copies costs about
as many links as it has members. All likeness that counts is within families.

Verdict. The shingle sets of a family's members are dealt into blocks of about
``BLOCK_NODES`` members or ``BLOCK_SHINGLES`` shingles. A task takes two blocks, counts the common shingles
of all pairs as products of incidence matrices, and sends on a spanning forest of the pairs
that reach ``least``: what leaves it is bounded by what is alike, not by what was compared.
Each block meets itself and the first block of its family. Where that leaves a family of several blocks
in more than one part, blocks are dealt again by part, and all pairs of blocks that hold
different parts meet. So every pair within a family is compared or joined already; what the
candidates miss is a matter of chance, see README.

NULL, empty and white texts are one node. Repeated rows, with or without an id, are rows of
one node and share its root. A very long text is one member whatever its size, in a block of
its own if need be. Likeness of exactly ``least`` links. Other columns are not looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.llm import simhash
from lapstream.llm.common import content_key
from lapstream.session import cut_lineage

WIDTH = 5
LEAST = 0.8
RADIUS = 14
VIEWS = 32
LEAD = 11
SKETCH = 128
SKETCH_RADIUS = 22
HASHES_AT_ONCE = 1 << 12
#: Views that are searched together: from each of these numbers up to the next.
TURNS_AT = (0, 4, 14, VIEWS)
BLOCK_NODES = 192
BLOCK_SHINGLES = 1 << 18
COLUMNS = 1 << 11

_draw = np.random.Generator(np.random.Philox(key=20240301))
TURNS = np.stack([_draw.permutation(simhash.BITS) for _ in range(VIEWS)])
FACTORS = _draw.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Node fields in a leaf: fingerprint as turned, id, two words of the sketch, label.
FIELDS = 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width])) for i in range(count)], dtype=np.uint64))


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """A bit of each of ``SKETCH`` min-wise draws, as two signed longs."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        low = np.minimum(low, (hashes[at : at + HASHES_AT_ONCE, None] * FACTORS).min(axis=0))
    bits = np.packbits((low * MIX >> np.uint64(63)).astype(np.uint8))
    first, second = bits.view(">i8").tolist()
    return first, second


def turned(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) with their bits in another order."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits[:, order]), axis=1).view(">u8").reshape(-1).astype(np.uint64)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, content, and node id, fingerprint and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for text in batch.column("text"):
                body = text.as_py()
                words = words_of(body)
                node = xxhash.xxh64_intdigest(b" ".join(words), 7)
                code = simhash.fingerprint_of(body)
                signed = [x - (1 << 64) if x >> 63 else x for x in (node, code)]
                found.append((*signed, *sketch(shingles(words))))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), *columns],
                ["doc_id", "content", "node_id", "code", "s0", "s1"],
            )

    rows = docs.select("doc_id", content_key(F.col("text")).alias("content"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(
        run, f"doc_id {kind}, content bigint, node_id bigint, code bigint, s0 bigint, s1 bigint"
    )


def leaves(nodes: DataFrame, leaf: int, sides: range) -> DataFrame:
    """Runs of neighbours in Gray order in the views ``sides``: side, task, run, mask, value, codes
    (``FIELDS`` numbers a node)."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().view(np.uint64)
            for side in sides:
                order = TURNS[side]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(codes), side, dtype=np.int32)),
                        pa.array(turned(codes, order).view(np.int64)),
                        *(batch.column(c) for c in ("node_id", "s0", "s1", "label")),
                    ],
                    ["side", "code", "node_id", "s0", "s1", "label"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = TaskContext.get().partitionId(), 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["side", "task", "run", "mask", "value", "codes"]
        kept = np.zeros((0, FIELDS + 1), dtype=np.int64)

        def groups(final: bool) -> Iterator[np.ndarray]:
            nonlocal kept
            at = 0
            while at < len(kept):
                end = at + int(np.searchsorted(kept[at:, 0], kept[at, 0], side="right"))
                if end == len(kept) and not final and end - at < leaf:
                    break
                yield kept[at : min(end, at + leaf)]
                at = min(end, at + leaf)
            kept = kept[at:]

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal run
            rows = []
            for part in groups(final):
                every, some = np.bitwise_and.reduce(part[:, 1]), np.bitwise_or.reduce(part[:, 1])
                mask = ~(every ^ some)
                rows.append((int(part[0, 0]), task, run, int(mask), int(every & mask), part[:, 1:].ravel()))
                run += 1
            if rows:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            fields = ("side", "code", "node_id", "s0", "s1", "label")
            more = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in fields], axis=1)
            kept = np.concatenate([kept, more])
            yield from out(False)
        yield from out(True)

    many = "side int, code bigint, node_id bigint, s0 bigint, s1 bigint, label bigint"
    copies = nodes.select("code", "node_id", "s0", "s1", "label").mapInArrow(views, many)
    ordered = (
        copies.withColumn("rank", simhash.gray_rank(F.col("code")))
        .repartitionByRange("side", "rank")
        .sortWithinPartitions("side", "rank")
        .drop("rank")
    )
    return ordered.mapInArrow(cut, "side int, task int, run bigint, mask bigint, value bigint, codes array<bigint>")


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest."""
    up: dict[int, int] = {}

    def find(n: int) -> int:
        while up.setdefault(n, n) != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    taken = []
    for place, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            taken.append(place)
    return np.array(taken, dtype=np.int64)


def among(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (u < v) that candidates of two leaves join: a spanning forest."""
    x = a[:, 0].view(np.uint64)[:, None] ^ b[:, 0].view(np.uint64)[None, :]
    linked = (np.bitwise_count(x) <= RADIUS) & (x >> np.uint64(simhash.BITS - LEAD) == 0)
    linked &= a[:, 4][:, None] != b[:, 4][None, :]
    i, j = np.nonzero(linked)
    far = np.bitwise_count((a[i, 2:4] ^ b[j, 2:4]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    near = far <= SKETCH_RADIUS
    u, v = a[i[near], 4], b[j[near], 4]
    u, v = np.minimum(u, v), np.maximum(u, v)
    u, v = np.unique(np.stack([u, v], axis=1), axis=0).T
    best = forest(u, v)
    return u[best], v[best]


def joining(rows: DataFrame) -> DataFrame:
    """Links (u, v) of labels from rows of two leaves (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                u, v = among(*(np.array(x.values).reshape(-1, FIELDS) for x in (a, b)))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.mapInArrow(compare, "u bigint, v bigint").distinct()


def relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the component of their label for a label."""
    known = simhash.components(links).select(F.col("u").alias("label"), "root")
    joined = nodes.join(known, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    return cut_lineage(joined, "near-labels")


def families(nodes: DataFrame, leaf: int = simhash.LEAF) -> DataFrame:
    """Nodes (node_id, content, code, s0, s1) with the label of their family of candidates."""
    nodes = nodes.withColumn("label", F.col("node_id"))
    alone = cut_lineage(leaves(nodes, leaf, range(TURNS_AT[1])), "near-runs")
    nodes = relabelled(nodes, joining(alone.select(F.col("codes").alias("a"), F.col("codes").alias("b"))))
    for first, after in pairwise(TURNS_AT):
        runs = cut_lineage(leaves(nodes, leaf, range(first, after)), "near-runs")
        found = cut_lineage(simhash.numbered(runs), "near-leaves")
        pairs = simhash.leaf_pairs(simhash.node_levels(found), RADIUS, widths=[LEAD] * VIEWS)
        left = found.select("side", "node", F.col("codes").alias("a"))
        right = found.select("side", F.col("node").alias("node_b"), F.col("codes").alias("b"))
        rows = pairs.join(left, ["side", "node"]).join(right, ["side", "node_b"]).select("a", "b")
        nodes = relabelled(nodes, joining(rows))
    return nodes


# verdict ------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, label, packed shingles and their number, of all members (node_id, content, label)."""
    keyed = docs.select(content_key(F.col("text")).alias("content"), F.col("text").cast("string").alias("text"))
    texts = keyed.join(members.select("content", "node_id", "label"), "content").dropDuplicates(["node_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py())) for t in batch.column("text")]
            columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node_id"), batch.column("label"), *columns], ["node_id", "label", "hashes", "n"]
            )

    return texts.select("node_id", "label", "text").mapInArrow(
        run, "node_id bigint, label bigint, hashes binary, n bigint"
    )


def common(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Shingles that each of the first ``split`` sets has in common with each of the rest (with
    each set, where ``split`` is their number), as products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    rest = slice(split, None) if split < len(sets) else slice(None)
    found = np.zeros((split, len(sets) - split or split), dtype=np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, (low, low + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], place[a:b] - low] = 1
        found += held[:split] @ held[rest].T
    return found


def joined_parts(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Least label that each of the members reaches over links and equal labels."""
    none = np.iinfo(np.int64).max
    low = labels
    while True:
        more = np.minimum(low, np.where(linked, low[None, :], none).min(axis=1))
        kind, first = np.unique(labels, return_inverse=True)
        least = np.full(len(kind), none)
        np.minimum.at(least, first, more)
        more = least[first]
        if (more == low).all():
            return low
        low = more


def alike(rows: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of parts with members alike, from rows of two blocks: a and b, arrays of (part,
    hashes); b is NULL where a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].as_py() for c in ("a", "b"))
                every = a + (b or [])
                sets = [np.frombuffer(x["hashes"], np.uint64) for x in every]
                parts = np.array([x["part"] for x in every], dtype=np.int64)
                sizes = np.array([len(x) for x in sets], dtype=np.float64)
                both = common(sets, len(a))
                right = slice(len(a), None) if b else slice(None)
                close = both >= least * (sizes[: len(a), None] + sizes[right][None, :] - both)
                linked = np.zeros((len(every), len(every)), dtype=bool)
                linked[: len(a), right] = close
                reached = joined_parts(linked | linked.T, parts)
                moved = reached != parts
                if moved.any():
                    u, v = np.unique(np.stack([reached[moved], parts[moved]], axis=1), axis=0).T
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.select("a", "b").mapInArrow(run, "u bigint, v bigint")


def blocked(members: DataFrame, by: list[str]) -> DataFrame:
    """Members of each block (label, ``by``) as an array of (part, hashes)."""
    return members.groupBy("label", *by).agg(F.collect_list(F.struct("part", "hashes")).alias("all"))


def first_links(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Links from blocks with themselves and with the first block of their family."""
    dealt = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")))
    found = cut_lineage(blocked(dealt.withColumn("part", F.col("node_id")), ["block"]), "near-blocks")
    own = found.select(F.col("all").alias("a"), F.lit(None).cast(found.schema["all"].dataType).alias("b"))
    head = found.filter("block = 0").select("label", F.col("all").alias("a"))
    met = found.filter("block > 0").select("label", F.col("all").alias("b")).join(head, "label").select("a", "b")
    return cut_lineage(alike(own, least).unionByName(alike(met, least)), "near-links")


def other_links(members: DataFrame, links: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Links between the parts that are left in families of several blocks."""
    known = simhash.components(links).select(F.col("u").alias("node_id"), F.col("root").alias("part"))
    parted = members.join(sizes.filter("blocks > 1").select("label"), "label", "left_semi").join(known, "node_id", "left")
    parted = cut_lineage(parted.withColumn("part", F.coalesce("part", "node_id")), "near-parted")
    counts = parted.groupBy("label", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    split = counts.groupBy("label").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    counts = cut_lineage(counts.join(split.select("label"), "label", "left_semi"), "near-counts")
    number = F.ceil(F.greatest(F.col("m") / BLOCK_NODES, F.col("w") / BLOCK_SHINGLES)).cast("bigint")
    # A part that fills a block is dealt by itself, the others together.
    whole = counts.withColumn("own", F.when(number > 1, F.col("part"))).withColumn("number", number)
    pooled = whole.filter("own is null").groupBy("label").agg(
        F.ceil(F.greatest(F.sum("m") / BLOCK_NODES, F.sum("w") / BLOCK_SHINGLES)).cast("bigint").alias("pool")
    )
    plan = cut_lineage(
        whole.join(pooled, "label", "left").select(
            "label", "part", "own", F.when(F.col("own").isNull(), F.col("pool")).otherwise(F.col("number")).alias("blocks")
        ),
        "near-plan",
    )
    dealt = parted.join(plan, ["label", "part"]).withColumn(
        "block", F.pmod(F.xxhash64(F.coalesce("own", F.lit(0)), F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("node_id"))), F.col("blocks"))
    )
    found = cut_lineage(
        blocked(dealt, ["own", "block"]).withColumn("id", F.xxhash64("label", "own", "block")), "near-blocks"
    )
    ids = found.select("label", "own", "id")
    other = found.select("label", F.col("own").alias("own_b"), F.col("id").alias("id_b"))
    pairs = ids.join(other, "label").filter("id < id_b and (own is null or own_b is null or own <> own_b)")
    a, b = (found.select(F.col("id").alias(i), F.col("all").alias(n)) for i, n in (("id", "a"), ("id_b", "b")))
    crossed = cut_lineage(pairs.select("id", "id_b"), "near-meetings").join(a, "id").join(b, "id_b").select("a", "b")
    inside = found.filter("own is null").select(
        F.col("all").alias("a"), F.lit(None).cast(found.schema["all"].dataType).alias("b")
    )
    return cut_lineage(alike(inside.unionByName(crossed), least), "near-links")


def near_copies(docs: DataFrame, least: float = LEAST, leaf: int = simhash.LEAF) -> DataFrame:
    """doc_id, root and content of every document; ``root`` names the component."""
    rows = cut_lineage(marks(docs), "near-rows")
    nodes = cut_lineage(
        rows.groupBy("node_id").agg(*[F.min(c).alias(c) for c in ("content", "code", "s0", "s1")]), "near-nodes"
    )
    labelled = families(nodes, leaf)
    several = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut_lineage(
        labelled.join(several.select("label"), "label", "left_semi").select("node_id", "content", "label"), "near-members"
    )
    sets = cut_lineage(shingle_sets(docs, members), "near-sets")
    sizes = sets.groupBy("label").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("bigint").alias("blocks")
    )
    sizes = cut_lineage(sizes.withColumn("blocks", F.greatest("blocks", F.lit(1))), "near-sizes")
    links = first_links(sets, sizes, least)
    if not sizes.filter("blocks > 1").isEmpty():
        links = links.unionByName(other_links(sets, links, sizes, least))
    known = cut_lineage(simhash.components(links), "near-components").select(F.col("u").alias("node_id"), "root")
    return rows.join(known, "node_id", "left").select("doc_id", F.coalesce("root", "node_id").alias("root"), "content")
