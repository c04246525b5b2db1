"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces. A document is its tokens and an end token; one above ``capacity`` is cut so that all
pieces but the first are full. Texts are tokenized where they are read; only piece rows
(ids, lengths, checksums) go on, so a long text leaves its task in parts.

Shards. Pieces below capacity are dealt by hash into shards of about ``SHARD`` pieces. Every
shard is evolved by ``ISLANDS`` islands, each a row of its own with a population of
groupings, so all islands of all shards run side by side. A generation takes two parents:
well-filled bins of the first are injected whole into the second, bins of the second that
hold a document twice are removed, and the documents they displace are put back by best fit,
largest first. Now and then the emptiest bins are taken apart instead. A child replaces the
worst grouping if it is better: fewer bins, then the greater sum of squared fills. After
every epoch each island hands its ``ELITE`` best groupings to the next island of the ring.

Rounds. Once a shard is settled, its fullest bins are final. The emptiest ``OPEN`` share of its
bins is opened, and what they hold is dealt into new shards, until one shard holds all that
is left; a bin lost to cutting into shards is won back there.

One island starts from best fit decreasing and the best grouping always stays, so a shard
never takes more bins than best fit decreasing takes. Seeds come from shard, island and
epoch: a rerun over the same written pieces agrees.

NULL and empty texts are a piece of one token. Every row is packed, repeated rows and rows
with a NULL id as often as they occur. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.llm.bpe import added_tokens, byte_letters, load, splitter
from lapstream.session import cut_lineage

CAPACITY = 1024
END = 2
SHARD = 4096
ISLANDS = 3
POPULATION = 5
ELITE = 2
EPOCHS = 3
GENERATIONS = 60
#: Share of bins that one crossover injects, and of bins that one mutation takes apart.
INJECT, APART = 0.12, 0.03
#: Share of the bins of a shard that the next round may pack anew.
OPEN = 0.125
BATCH_PIECES = 1 << 14
#: Splitting rule of byte-level vocabularies.
RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# pieces -------------------------------------------------------------------------


def encoder(model: str):
    """Function from a text to its token ids (unsigned 32 bit), as the tokenizers library gives them.

    Texts up to U+00FF, where no version of Unicode differs, are merged by tiktoken, which
    needs ids in the order of the merges; that is checked. Other texts go word by word
    through the library's own splitting and merging.
    """
    tokenizer = load(model)
    form, letters = json.loads(model), byte_letters()
    vocabulary = form["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in form["model"]["merges"]]
    in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    added, words_of = added_tokens(tokenizer), splitter(tokenizer)
    core = None
    if in_order and not form["pre_tokenizer"]["add_prefix_space"]:
        ranks = {p.translate(letters).encode("latin-1"): i for p, i in vocabulary.items() if p not in added}
        core = tiktoken.Encoding("own", pat_str=RULE, mergeable_ranks=ranks, special_tokens={})
    bytes_of = {b: chr(c) for c, b in letters.items()}
    table: dict[str, list[int]] = {t: [n] for t, n in added.items()}

    def slow(text: str) -> np.ndarray:
        ids: list[int] = []
        for word in words_of(text):
            found = table.get(word)
            if found is None:
                piece = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(bytes_of)
                found = [t.id for t in tokenizer.model.tokenize(piece)]
                if len(table) < 1 << 18:
                    table[word] = found
            ids += found
        return np.array(ids, dtype="<u4")

    def encode(text: str) -> np.ndarray:
        if core is not None and not any(t in text for t in added):
            try:
                text.encode("latin-1")
                return np.array(core.encode_ordinary(text), dtype="<u4")
            except UnicodeEncodeError:
                pass
        return slow(text)

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, item, piece, start, length, ids_crc32 of every piece; ``item`` numbers them all."""
    with open(path, encoding="utf-8") as file:
        model = file.read()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, count = encoder(model), TaskContext.get().partitionId(), 0
        for batch in batches:
            kind_of_id = batch.column("doc_id").type
            held: list[tuple] = []

            def out() -> pa.RecordBatch:
                nonlocal count
                columns = [list(c) for c in zip(*held, strict=True)]
                item = np.arange(count, count + len(held)) + (task << 36)
                count += len(held)
                held.clear()
                arrays = [pa.array(c, k) for c, k in zip(columns, [kind_of_id, *[pa.int64()] * 4], strict=True)]
                return pa.RecordBatch.from_arrays(
                    [arrays[0], pa.array(item), *arrays[1:]], ["doc_id", "item", "piece", "start", "length", "ids_crc32"]
                )

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end], dtype="<u4"))
                size = len(ids)
                first = size - capacity * (-(-size // capacity) - 1)
                body, low = memoryview(ids.tobytes()), 0
                for number, high in enumerate(range(first, size + 1, capacity)):
                    held.append((doc_id, number, low, high - low, zlib.crc32(body[4 * low : 4 * high])))
                    low = high
                    if len(held) >= BATCH_PIECES:
                        yield out()
            if held:
                yield out()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, item bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint"
    )


# groupings ----------------------------------------------------------------------


def best_fit(sizes: list[int], order: list[int], bins: list[int], room: list[int], capacity: int) -> None:
    """Put the items of ``order`` (item numbers) into the bins with the least room that holds
    them; ``bins`` gets each item's bin, ``room`` the room left of each bin, new ones behind.

    Bins are kept by room, and a number with a bit per room that has one finds the least."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, free in enumerate(room):
        if free:
            by_room[free].append(b)
            open_ |= 1 << free
    for item in order:
        size = sizes[item]
        fitting = open_ >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            held = by_room[free]
            b = held.pop()
            if not held:
                open_ ^= 1 << free
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins[item] = b
        left = free - size
        room[b] = left
        if left:
            by_room[left].append(b)
            open_ |= 1 << left


def compact(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered without gaps, and the fill of each."""
    bins = np.unique(bins, return_inverse=True)[1].astype(np.int32)
    return bins, np.bincount(bins, weights=sizes).astype(np.int64)


def fitness(fills: np.ndarray) -> tuple[int, int]:
    """To be minimised: bins, then less the sum of squared fills."""
    return len(fills), -int((fills * fills).sum())


def packed(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = [0] * len(sizes)
    best_fit(sizes.tolist(), order.tolist(), bins, [], capacity)
    return np.array(bins, dtype=np.int32)


def refit(bins: np.ndarray, sizes: np.ndarray, out: np.ndarray, capacity: int) -> np.ndarray:
    """A grouping in which the items marked in ``out`` are put back by best fit, largest first."""
    stay = ~out
    numbers = np.full(len(bins), -1, dtype=np.int64)
    kept, fills = compact(bins[stay], sizes[stay]) if stay.any() else (bins[:0], sizes[:0])
    numbers[stay] = kept
    place = numbers.tolist()
    moved = np.flatnonzero(out)
    order = moved[np.argsort(-sizes[moved], kind="stable")]
    best_fit(sizes.tolist(), order.tolist(), place, (capacity - fills).tolist(), capacity)
    return np.array(place, dtype=np.int32)


def crossed(
    first: np.ndarray, second: np.ndarray, sizes: np.ndarray, capacity: int, draw: np.random.Generator
) -> np.ndarray:
    """Inject well-filled bins of ``first`` into ``second``."""
    fills = np.bincount(first, weights=sizes)
    count = max(1, int(INJECT * len(fills)))
    # Full bins come first; noise of a few tokens lets other bins of much the same fill in.
    chosen = np.argsort(-(fills + draw.exponential(capacity / 64, len(fills))))[:count]
    whole = np.zeros(len(fills), dtype=bool)
    whole[chosen] = True
    injected = whole[first]
    hit = np.zeros(int(second.max()) + 1, dtype=bool)
    hit[second[injected]] = True
    displaced = hit[second] & ~injected
    child = second.astype(np.int64)
    child[injected] = first[injected] + len(hit)
    return refit(child, sizes, displaced, capacity)


def mutated(bins: np.ndarray, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Take the emptiest bins, and a few others, apart."""
    fills = np.bincount(bins, weights=sizes)
    count = max(1, int(APART * len(fills)))
    apart = np.zeros(len(fills), dtype=bool)
    apart[np.argsort(fills, kind="stable")[:count]] = True
    apart[draw.integers(0, len(fills), count)] = True
    return refit(bins, sizes, apart[bins], capacity)


def evolved(sizes: np.ndarray, genes: list[np.ndarray], seed: list[int], capacity: int, generations: int) -> list[np.ndarray]:
    """A population after some generations, best first. Without genes one is begun."""
    draw = np.random.Generator(np.random.PCG64(seed))
    if not genes:
        genes = [packed(sizes, np.argsort(-sizes, kind="stable"), capacity)]
    while len(genes) < POPULATION:
        # Nearly falling sizes: near best fit decreasing, but another grouping every time.
        genes.append(packed(sizes, np.argsort(-sizes * draw.uniform(0.75, 1, len(sizes))), capacity))
    people = sorted(((*fitness(np.bincount(g, weights=sizes).astype(np.int64)), n) for n, g in enumerate(genes)))
    scores, genes = [p[:2] for p in people], [genes[p[2]] for p in people]
    least = -(-int(sizes.sum()) // capacity)
    for turn in range(generations):
        if scores[0][0] <= least:
            break
        a, b = draw.permutation(len(genes))[:2]
        if turn % 4 == 3:
            child = mutated(genes[min(a, b)], sizes, capacity, draw)
        else:
            child = crossed(genes[min(a, b)], genes[max(a, b)], sizes, capacity, draw)
        score = fitness(np.bincount(child, weights=sizes).astype(np.int64))
        if score < scores[-1] and score not in scores:
            at = next(i for i, s in enumerate(scores) if score < s)
            scores.insert(at, score)
            genes.insert(at, child)
            scores.pop()
            genes.pop()
    return genes[:POPULATION]


# islands ------------------------------------------------------------------------


def tasks_for(rows: int, cores: int) -> int:
    """Tasks for so many islands: a few each while there are cores, more on large inputs."""
    return max(1, min(-(-rows // 2), max(4 * cores, -(-rows // 64))))


def evolve(state: DataFrame, epoch: int, tasks: int, capacity: int, generations: int, last: bool) -> DataFrame:
    """One epoch of every island (shard, island, sizes, genes, arriving)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                genes = [np.frombuffer(g, "<i4") for g in (row["genes"] or []) + (row["arriving"] or [])]
                seed = [row["shard"] & (2**63 - 1), row["island"], epoch]
                found = evolved(sizes, genes, seed, capacity, generations)
                score = fitness(np.bincount(found[0], weights=sizes).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]], pa.int64()),
                        pa.array([row["island"]], pa.int32()),
                        pa.array([row["sizes"]], pa.binary()),
                        pa.array([[g.astype("<i4").tobytes() for g in (found[:1] if last else found)]], pa.list_(pa.binary())),
                        pa.array([score[0]], pa.int64()),
                        pa.array([score[1]], pa.int64()),
                    ],
                    ["shard", "island", "sizes", "genes", "bins", "squares"],
                )

    dealt = state.select("shard", "island", "sizes", "genes", "arriving").repartition(tasks, "shard", "island")
    return dealt.mapInArrow(
        run, "shard bigint, island int, sizes binary, genes array<binary>, bins bigint, squares bigint"
    )


def shards(items: DataFrame, count: int, size: int) -> DataFrame:
    """shard, items and sizes (packed) of all pieces (item, length)."""
    number = max(1, -(-count // size))
    grouped = (
        items.groupBy(F.expr(f"pmod(xxhash64(item), {number})").alias("shard"))
        .agg(F.sort_array(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("all"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, row in zip(batch.column("shard").to_pylist(), batch.column("all"), strict=True):
                both = row.values
                columns = [
                    pa.array([shard], pa.int64()),
                    pa.array([both.field("item").to_numpy().astype("<i8").tobytes()], pa.binary()),
                    pa.array([both.field("length").to_numpy().astype("<i4").tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "items", "sizes"])

    return grouped.mapInArrow(pack, "shard bigint, items binary, sizes binary")


def settle(best: DataFrame, capacity: int, last: bool) -> DataFrame:
    """item, length, bin (within the shard), place in the bin, and whether the bin stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items = np.frombuffer(row["items"], "<i8")
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                bins, fills = compact(np.frombuffer(row["best"], "<i4"), sizes)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                starts = ends - sizes[order]
                first = np.searchsorted(bins[order], np.arange(len(fills)))
                open_ = np.zeros(len(fills), dtype=bool)
                if not last:
                    emptiest = np.argsort(fills, kind="stable")[: max(1, int(OPEN * len(fills)))]
                    open_[emptiest[fills[emptiest] < capacity]] = True
                columns = [
                    pa.array(items[order]),
                    pa.array(sizes[order]),
                    pa.array(np.full(len(items), row["shard"], dtype=np.int64)),
                    pa.array(bins[order].astype(np.int64)),
                    pa.array(starts - starts[first][bins[order]]),
                    pa.array(open_[bins[order]]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "length", "shard", "bin", "offset", "open"])

    return best.mapInArrow(
        run, "item bigint, length bigint, shard bigint, bin bigint, offset bigint, open boolean"
    )


def group(
    items: DataFrame,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
) -> DataFrame:
    """item, round, shard, bin and offset of every piece (item, length) below capacity."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    settled, number = [], 0
    while True:
        count = items.count()
        one = count <= 2 * shard
        held = cut_lineage(shards(items, 1 if one else count, shard), "packing-shards")
        tasks = tasks_for(islands * max(1, -(-count // shard)), cores)
        empty = F.array().cast("array<binary>")
        state = held.select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
            "sizes",
            empty.alias("genes"),
            empty.alias("arriving"),
        )
        for epoch in range(epochs):
            last = epoch == epochs - 1
            after = evolve(state, 100 * number + epoch, tasks, capacity, generations, last)
            after = cut_lineage(after, "packing-islands")
            movers = after.select(
                "shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("genes", 1, ELITE).alias("arriving")
            )
            state = after.join(movers, ["shard", "island"])
        best = after.groupBy("shard").agg(
            F.min_by(F.struct("genes"), F.struct("bins", "squares", "island"))["genes"][0].alias("best")
        )
        placed = cut_lineage(settle(held.join(best, "shard"), capacity, one), "packing-placed")
        settled.append(
            placed.filter("not open").select("item", F.lit(number).cast("long").alias("round"), "shard", "bin", "offset")
        )
        if one:
            break
        items, number = placed.filter("open").select("item", "length"), number + 1
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, **how: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    found = cut_lineage(pieces(docs, path, capacity, end), "packing-pieces")
    placed = group(found.filter(F.col("length") < capacity).select("item", "length"), capacity, **how)
    # Bins are numbered by round, shard and bin; a full piece is a sequence by itself, numbered below zero.
    sequence = F.shiftleft("round", 56) + F.shiftleft("shard", 24) + F.col("bin")
    joined = found.join(placed.select("item", sequence.alias("sequence_id"), "offset"), "item", "left")
    return joined.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        *["start", "length", "ids_crc32"],
        F.coalesce("sequence_id", -F.col("item") - 1).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"),
    )
