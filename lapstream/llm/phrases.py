"""Collocations per language by best-first branch and bound over word counts.

Texts are cut into pieces and words once. A task gathers the words of one language into
blocks of about ``BLOCK_WORDS``: the distinct words with their counts, and the positions as
word numbers. Counts of words are summed over all blocks. Words below ``least`` occurrences
are breaks from there on, as no candidate can hold one; the others get an id, and each block
its words' ids and counts, so later passes never see a text again.

Growth. From the counts a of a prefix of known words follows what any phrase through it can
score at most: with m the least count of its words, a phrase of 2 scores at most m*m/(f1*f2),
one of 3 at most m/max(f1, f3). The frontier of phrases not counted yet is expanded from the
highest bounds down, in bands. In a band the first pass counts the phrases whose bound lies
in it. The second counts what is needed to judge them: all phrases of 3 around a pair that
reached the band (to drop pairs inside longer candidates), and the pairs inside phrases of 3
(to score their cuts). A language is settled when ``top`` surviving candidates score at least
the band's floor, as then nothing unexpanded can enter or tie; the last band's floor is 0.

The second pass finds its phrases by a bitmap of fixed size, which may let others through;
joins on ids then make the counts exact. A frequent phrase is counted within a block before
anything is shuffled. Scores are exact: they are computed in decimals of 38 digits.

NULL text is empty, NULL lang is ``und``. Repeated rows count as often as they occur. A text
longer than a block goes on in the next one, which starts with its last two words for
context. Equal scores are ordered by count, then by phrase in byte order. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.llm.bpe import pack, unpack
from lapstream.session import cut_lineage

LEAST = 10
TOP = 2000
COVERED = 50
SCALE = 1_000_000
BLOCK_WORDS = 1 << 20
#: Bytes of text that are split at once; a longer text is split whole.
PORTION = 1 << 22
#: Floors of the bands, from the highest bounds down.
FLOORS = (300_000, 50_000, 2_000, 0)
BITS = 24
SALTS = 64
BREAK = b"\xff"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
CUTS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case; what ends a piece becomes a byte that no UTF-8 text holds.
TABLE = bytes.maketrans(UPPER + CUTS, LOWER + BREAK * len(CUTS))
NONE = -1


# blocks -------------------------------------------------------------------------


def tokens(texts: pa.Array) -> Iterator[pa.BinaryArray]:
    """Words of texts in order, with a break where a piece or a text ends, in portions of whole texts."""
    texts = texts.fill_null("").cast(pa.large_binary())
    portion = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PORTION
    ends = np.append(np.flatnonzero(np.diff(portion)) + 1, len(texts))
    for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        several = pa.LargeListArray.from_arrays(pa.array([0, high - low], pa.int64()), texts[low:high])
        body = pc.binary_join(several, pa.scalar(BREAK, pa.large_binary()))[0].as_py() + BREAK
        body = np.frombuffer(body.translate(TABLE), np.uint8)
        ended, blank = body == BREAK[0], (body == 32) | (body == 9)
        # A break is a word of its own; further ones behind it say nothing new.
        first = np.ones(len(body), dtype=bool)
        first[1:] = blank[:-1] | ended[1:] | ended[:-1]
        kept = ~blank
        kept[1:] &= ~(ended[1:] & ended[:-1])
        body, first = body[kept], np.flatnonzero(first[kept])
        offsets = pa.py_buffer(np.append(first, len(body)).astype(np.int32))
        yield pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(body)])


def tail_of(words: pa.Array) -> pa.Array:
    """The last two words, or those of them behind a break."""
    last = words[-2:].to_pylist()
    return words[len(words) - (last[::-1].index(BREAK) if BREAK in last else len(last)) :]


def block_of(words: pa.Array, context: int) -> tuple[pa.StructArray, bytes]:
    """Distinct words with their counts behind the context, most frequent first, and the number of
    the word at each position (0: a break)."""
    coded = pa.concat_arrays([pa.array([BREAK], pa.binary()), words]).dictionary_encode()
    at, names = coded.indices.to_numpy()[1:], coded.dictionary
    counts = np.bincount(at[context:], minlength=len(names))
    order = np.argsort(-counts[1:], kind="stable") + 1
    rank = np.zeros(len(names), dtype=np.int64)
    rank[order] = np.arange(1, len(names))
    listed = pa.StructArray.from_arrays([names.take(pa.array(order)).cast(pa.string()), pa.array(counts[order])], ["word", "n"])
    return listed, pack(rank[at])


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, block, words (word, n), packed positions, and words of context at the start.

    Words of several languages are held at once; when all together are ``block_words`` or more,
    the first ones of the language that holds most become a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, pa.Array] = {}
        fresh: dict[str, list[pa.Array]] = {}
        context: dict[str, int] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            every = pa.concat_arrays([*([held.pop(lang)] if lang in held else []), *fresh.pop(lang, [])])
            before = context.get(lang, 0)
            words, rest = every[: before + block_words], every[before + block_words :]
            listed, positions = block_of(words, before)
            row = [
                pa.array([lang]),
                pa.array([(task << 32) + number]),
                pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                pa.array([positions], pa.binary()),
                pa.array([before], pa.int32()),
            ]
            number += 1
            tail = tail_of(words)
            held[lang], context[lang], sizes[lang] = pa.concat_arrays([tail, rest]), len(tail), len(rest)
            return pa.RecordBatch.from_arrays(row, ["lang", "block", "words", "positions", "context"])

        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            for at, lang in enumerate(coded.dictionary.to_pylist()):
                for words in tokens(batch.column("text").filter(pc.equal(coded.indices, at))):
                    fresh.setdefault(lang, []).append(words)
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    while sum(sizes.values()) >= block_words:
                        yield out(max(sizes, key=sizes.__getitem__))
        for lang in list(sizes):
            while sizes[lang]:
                yield out(lang)
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        "lang string, block bigint, words array<struct<word string, n bigint>>, positions binary, context int",
    )


def slot_of(lang: str, word: str) -> Column:
    return F.pmod(F.xxhash64(lang, word), F.lit(1 << BITS))


def frequent_slots(words: DataFrame) -> DataFrame:
    """One row: the slots of the frequent words as an array of 64-bit words, 2**BITS bits at any size."""
    slot = words.select(slot_of("lang", "word").alias("slot"))
    filled = slot.groupBy(F.expr("slot div 64").alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")
    )
    every = words.sparkSession.range(1 << BITS - 6).select(F.col("id").alias("place"), F.lit(0).cast("bigint").alias("bits"))
    rows = every.unionByName(filled).groupBy("place").agg(F.sum("bits").alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("place", "bits")))
    return rows.agg(listed.alias("l")).select(F.col("l.bits").alias("slots"))


def coded_blocks(found: DataFrame, words: DataFrame) -> DataFrame:
    """lang, block, positions, context, and id and count of the frequent words by place.

    Only words whose slot is that of a frequent word are sent to the join."""
    slots = cut_lineage(frequent_slots(words), "phrases-slots")
    each = found.select("lang", "block", F.posexplode("words").alias("at", "w")).select(
        "lang", "block", "at", F.col("w.word").alias("word")
    )
    slot = slot_of("lang", "word")
    word = F.element_at(slots.scalar(), (F.shiftright(slot, 6) + 1).cast("int"))
    each = each.filter(F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1)
    known = (
        each.join(words.select("lang", "word", "id", "f"), ["lang", "word"])
        .groupBy("block")
        .agg(F.collect_list(F.struct("at", "id", "f")).alias("known"))
    )
    return found.select("lang", "block", "positions", "context").join(known, "block")


# passes -------------------------------------------------------------------------


def pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of each pair of ids in the bitmap."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(pairs: DataFrame) -> np.ndarray:
    """Bitmap of pairs (i1, i2), 2**BITS bits at any size."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(pair_slots(batch.column("i1").to_numpy(), batch.column("i2").to_numpy()))
            bits = np.uint64(1) << (slot & 63).astype(np.uint64)
            at, first = np.unique(slot >> 6, return_index=True)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64))], ["at", "bits"]
                )

    parts = pairs.select("i1", "i2").mapInArrow(words, "at bigint, bits bigint")
    rows = parts.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    full = np.zeros(1 << BITS - 6, dtype=np.uint64)
    full[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return full


def in_bitmap(full: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    slot = pair_slots(first, second)
    return (full[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a block as numbers of frequent words (0: a break), and their ids and counts."""
    at = unpack(row["positions"])[0].astype(np.int64)
    known = row["known"]
    size = int(at.max(initial=0)) + 1
    number = np.zeros(size, dtype=np.int64)
    number[known["at"] + 1] = np.arange(1, len(known["at"]) + 1)
    ids, counts = (np.concatenate([[0], known[c]]) for c in ("id", "f"))
    return number[at], ids, counts


def grams(at: np.ndarray, context: int, width: int) -> np.ndarray:
    """Rows of ``width`` neighbours without a break whose last one is not context."""
    at = at[max(0, context - width + 1) :]
    if len(at) < width:
        return np.zeros((0, width), dtype=np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(at, width)
    return seen[(seen > 0).all(axis=1)]


def tallied(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers, and how often each occurs."""
    base = int(rows.max()) + 1
    if base ** rows.shape[1] >= 1 << 63:
        return np.unique(rows, axis=0, return_counts=True)
    key = rows[:, 0]
    for i in range(1, rows.shape[1]):
        key = key * base + rows[:, i]
    key, n = np.unique(key, return_counts=True)
    parts = []
    for _ in range(rows.shape[1]):
        key, last = np.divmod(key, base)
        parts.append(last)
    return np.stack(parts[::-1], axis=1), n


def count(coded: DataFrame, choose) -> DataFrame:
    """lang, i1, i2, i3 (``NONE`` for a pair), a, and the counts f1, f2, f3 of the words, of the
    phrases that ``choose(pairs or triples, ids, counts)`` picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = batch.column("known")[i].values
                known = {c: listed.field(c).to_numpy().astype(np.int64) for c in ("at", "id", "f")}
                row = {"positions": batch.column("positions")[i].as_py(), "known": known}
                at, ids, counts = places(row)
                for width in (2, 3):
                    rows = grams(at, batch.column("context")[i].as_py(), width)
                    rows = rows[choose(rows, ids, counts)]
                    if len(rows):
                        rows, n = tallied(rows)
                        none = [np.full(len(n), NONE)] * (3 - width)
                        columns = [*ids[rows].T, *none, *counts[rows].T, *none, n]
                        lang = pa.array([batch.column("lang")[i].as_py()] * len(n), pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [lang, *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                            ["lang", "i1", "i2", "i3", "f1", "f2", "f3", "n"],
                        )

    kinds = ", ".join(f"{c} bigint" for c in ("i1", "i2", "i3", "f1", "f2", "f3", "n"))
    parts = coded.select("lang", "positions", "context", "known").mapInArrow(run, f"lang string, {kinds}")
    # The language and the counts of words follow from their ids.
    return parts.groupBy("lang", "i1", "i2", "i3").agg(F.sum("n").alias("a"), *[F.max(f).alias(f) for f in ("f1", "f2", "f3")])


def bound(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most that phrases of these words can score, times ``SCALE``; never below the score."""
    f = counts[rows].astype(np.float64)
    low = f.min(axis=1)
    if rows.shape[1] == 2:
        return SCALE * low / f.max(axis=1) * (1 + 1e-9) + 1e-6
    return SCALE * low / np.maximum(f[:, 0], f[:, 2]) * (1 + 1e-9) + 1e-6


def first_pass(floor: int, above: int | None):
    def choose(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        most = bound(rows, counts)
        return (most >= floor) & (most < above if above is not None else True)

    return choose


def second_pass(pairs: np.ndarray, needed: np.ndarray):
    def choose(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        named = ids[rows]
        if rows.shape[1] == 2:
            return in_bitmap(needed, named[:, 0], named[:, 1])
        return in_bitmap(pairs, named[:, 0], named[:, 1]) | in_bitmap(pairs, named[:, 1], named[:, 2])

    return choose


# scores -------------------------------------------------------------------------


def score(a: str, part: str, rest: str) -> Column:
    """floor(SCALE * a * a / (part * rest)), exact."""
    a, part, rest = (f"cast({x} as decimal(19, 0))" for x in (a, part, rest))
    return F.expr(f"(({a} * {a}) * cast({SCALE} as decimal(7, 0))) div ({part} * {rest})")


def scored_pairs(counts: DataFrame) -> DataFrame:
    return counts.select("lang", "i1", "i2", "a", "f1", "f2", score("a", "f1", "f2").alias("score"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, floors: tuple[int, ...] = FLOORS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    found = cut_lineage(blocks(docs, block_words), "phrases-blocks")
    tally = (
        found.select("lang", F.inline("words")).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    )
    tally = cut_lineage(tally, "phrases-tally")
    sizes = cut_lineage(tally.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-sizes")
    words = cut_lineage(tally.filter(F.col("f") >= least), "phrases-frequent")
    words = cut_lineage(words.withColumn("id", F.monotonically_increasing_id()), "phrases-words")
    coded = cut_lineage(coded_blocks(found, words), "phrases-coded")
    open_ = sizes.select("lang")
    pairs = triples = around = None
    settled, above = [], None
    for floor in floors:
        rest = coded.join(open_, "lang", "left_semi")
        tried = cut_lineage(count(rest, first_pass(floor, above)).filter(F.col("a") >= least), "phrases-tried")
        # A pair that a cut needed in an earlier band is known by now.
        fresh = tried.filter(f"i3 = {NONE}")
        fresh = fresh if pairs is None else fresh.join(pairs.select("i1", "i2"), ["i1", "i2"], "left_anti")
        more = scored_pairs(fresh)
        pairs = cut_lineage(more if pairs is None else pairs.unionByName(more), "phrases-pairs")
        more = tried.filter(f"i3 <> {NONE}")
        triples = cut_lineage(more if triples is None else triples.unionByName(more), "phrases-triples")
        reached = pairs.filter(F.col("score") >= floor)
        if above is not None:
            reached = reached.filter(F.col("score") < above)
        cuts = more.select("i1", "i2").unionByName(more.select(F.col("i2").alias("i1"), F.col("i3").alias("i2")))
        cuts = cuts.distinct().join(pairs, ["i1", "i2"], "left_anti")
        asked = count(rest, second_pass(bitmap(reached), bitmap(cuts))).filter(F.col("a") >= least)
        asked = cut_lineage(asked, "phrases-asked")
        # Pairs counted for their own score come first; those counted for a cut alone join them.
        alone = asked.filter(f"i3 = {NONE}").join(cuts, ["i1", "i2"], "left_semi")
        pairs = cut_lineage(pairs.unionByName(scored_pairs(alone)), "phrases-pairs")
        more = asked.filter(f"i3 <> {NONE}").select("i1", "i2", "i3", "a")
        around = cut_lineage(more if around is None else around.unionByName(more), "phrases-around")

        kept = survivors(pairs, triples, around, floor).join(open_, "lang", "left_semi")
        kept = cut_lineage(kept, "phrases-kept")
        done = open_ if floor == 0 else kept.groupBy("lang").count().filter(F.col("count") >= top).select("lang")
        done = cut_lineage(done, "phrases-done")
        settled.append(kept.join(done, "lang", "left_semi"))
        open_ = cut_lineage(open_.join(done, "lang", "left_anti"), "phrases-open")
        above = floor
        if open_.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    every = labelled(every, words)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within salted parts of a language, then among the first of each part.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    early = every.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (
        ranked.filter(F.col("rank") <= top)
        .join(sizes, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def survivors(pairs: DataFrame, triples: DataFrame, around: DataFrame, floor: int) -> DataFrame:
    """lang, i1, i2, i3, a, l, r, score of all candidates that score at least ``floor`` and stay."""
    longer = around.unionByName(triples.select("i1", "i2", "i3", "a")).distinct()
    inside = longer.select("i1", "i2", F.col("a").alias("b")).unionByName(
        longer.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), F.col("a").alias("b"))
    )
    most = inside.groupBy("i1", "i2").agg(F.max("b").alias("b"))
    two = (
        pairs.filter(F.col("score") >= floor)
        .join(most, ["i1", "i2"], "left")
        .filter(F.col("b").isNull() | (F.expr("cast(b as decimal(19, 0)) * 100") < F.expr(f"cast(a as decimal(19, 0)) * {COVERED}")))
        .select("lang", "i1", "i2", F.lit(NONE).cast("bigint").alias("i3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    )
    head = pairs.select("i1", "i2", F.col("a").alias("p"))
    tail = pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("a").alias("q"))
    cut = triples.join(head, ["i1", "i2"]).join(tail, ["i2", "i3"])
    cut = cut.withColumns({"s1": score("a", "f1", "q"), "s2": score("a", "p", "f3")})
    first = F.col("s1") <= F.col("s2")
    three = cut.select(
        *["lang", "i1", "i2", "i3", "a"],
        F.when(first, F.col("f1")).otherwise(F.col("p")).alias("l"),
        F.when(first, F.col("q")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    ).filter(F.col("score") >= floor)
    return two.unionByName(three)


def labelled(every: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases (i1, i2, i3)."""
    for i in (1, 2, 3):
        label = words.select(F.col("id").alias(f"i{i}"), F.col("word").alias(f"w{i}"))
        every = every.join(label, f"i{i}", "left")
    return every.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
