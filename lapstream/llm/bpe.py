"""BPE encoding and decoding over tables of distinct words.

Texts are split into words as the tokenizer splits them. A task collects about
``BLOCK_WORDS`` words into a block: its distinct words, dealt into parts by hash, and for
every position of its texts the number of its word. Parts of all blocks meet by hash, so a
word is encoded in one place, once, whatever number of blocks and positions it has. Its
ids go back to the blocks and are joined to the positions by word number; the ids of a text
are then joined with the id-to-piece table, which has as many rows as the vocabulary, and
the pieces in order are the decoded text.

A word occurs once per block at most before it is shuffled, so a very frequent word is
spread as thin as the blocks. Texts move as compressed word numbers, once. Blocks are
bounded by a number of words, or hold one long text. The table of a task forgets its words
when it holds ``TABLE_WORDS``; a word may then be encoded again.

NULL counts as empty: no ids, an empty decoded text. Every row comes back, repeated ones
as often as they occur. Special tokens of the file are recognised in texts as the library
does by default. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BLOCK_WORDS = 1 << 21
TABLE_WORDS = 1 << 20
#: Characters with which byte-level vocabularies write the bytes that do not print.
PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[int, int]:
    """Code point of a byte-level character to its byte."""
    rest = [b for b in range(256) if b not in PRINTING]
    return {b: b for b in PRINTING} | {256 + i: b for i, b in enumerate(rest)}


def load(text: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def added_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Tokens that are cut out of a text before it is split."""
    added = tokenizer.get_added_tokens_decoder()
    for token in added.values():
        if token.single_word or token.lstrip or token.rstrip:
            raise ValueError(f"token {token.content!r} depends on the characters around it")
    return {token.content: number for number, token in added.items()}


#: Letters, numbers and white space up to U+00FF, where no version of Unicode differs.
LETTER, NUMBER, SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: The splitting rule of byte-level vocabularies for texts within that range.
SIMPLE = re.compile(
    rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{LETTER}{NUMBER}{SPACE}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def plain_splitter(tokenizer: Tokenizer):
    """Function from a text without special tokens to its words."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    form = json.loads(tokenizer.to_str())
    rule = form["pre_tokenizer"]
    simple = rule["type"] == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
    if form["normalizer"] is not None or rule["type"] != "ByteLevel":
        raise ValueError("only byte-level vocabularies without a normalizer are supported")

    def words(text: str) -> list[str]:
        if simple:
            try:
                text.encode("latin-1")
                return SIMPLE.findall(text)
            except UnicodeEncodeError:
                pass
        return [text[a:b] for _, (a, b) in split(text)]

    return words


def splitter(tokenizer: Tokenizer):
    """Function from a text to its words; special tokens are words of their own."""
    added = sorted(added_tokens(tokenizer), key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    split, special = plain_splitter(tokenizer), set(added)

    def words(text: str) -> list[str]:
        if cut is None or not any(t in text for t in added):
            return split(text)
        found: list[str] = []
        for part in cut.split(text):
            found += [part] if part in special else split(part)
        return found

    return words


def pack(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Numbers, byte plane by byte plane, and bytes behind them, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    head = np.array([len(numbers)], dtype="<i8").tobytes()
    return zstandard.compress(head + planes.tobytes() + rest, 1)


def unpack(body: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(body)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(raw, np.uint8, 4 * count, 8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1), raw[8 + 4 * count :]


def blocks(docs: DataFrame, model: str, parts: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per block its documents' ids and word counts, the packed word numbers of all
    positions, the part of each word, and the packed words of each part."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter(load(model))
        block, task = 0, TaskContext.get().partitionId()
        place: dict[str, int] = {}
        positions: list[int] = []
        ids: list = []
        counts: list[int] = []
        id_type = None

        def out() -> pa.RecordBatch:
            nonlocal block
            at = np.array(positions, dtype=np.int64)
            # The most frequent words get the smallest numbers, which pack best.
            often = np.argsort(-np.bincount(at, minlength=len(place)), kind="stable")
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            names = [n.encode("utf-8", "surrogatepass") for n in place]
            names = [names[i] for i in often.tolist()]
            part = np.fromiter((zlib.crc32(n) % parts for n in names), dtype=np.int64, count=len(names))
            groups: list[list[bytes]] = [[] for _ in range(parts)]
            for p, name in zip(part.tolist(), names, strict=True):
                groups[p].append(name)
            packed = [pack(np.array([len(n) for n in g], dtype=np.int64), b"".join(g)) for g in groups]
            row = [
                pa.array([(task << 32) + block]),
                pa.array([ids], pa.list_(id_type)),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([pack(rank[at] if len(at) else at)], pa.binary()),
                pa.array([pack(part)], pa.binary()),
                pa.array([packed], pa.list_(pa.binary())),
            ]
            block += 1
            for held in (place, positions, ids, counts):
                held.clear()
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "counts", "positions", "part", "words"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py() or "")
                positions += [place.setdefault(w, len(place)) for w in words]
                ids.append(doc_id)
                counts.append(len(words))
                if len(positions) >= block_words or len(ids) >= block_words:
                    yield out()
        if ids:
            yield out()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        f"block bigint, ids array<{kind}>, counts array<bigint>, positions binary, part binary, words array<binary>",
    )


def part_words(found: DataFrame) -> DataFrame:
    """block, part and the packed words of every part. It takes whole blocks, so that what
    is read here and what is joined later are the same shuffled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                bodies = words.values
                columns = [
                    pa.array(np.full(len(bodies), block)),
                    pa.array(np.arange(len(bodies), dtype=np.int32)),
                    bodies.cast(pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "words"])

    return found.mapInArrow(run, "block bigint, part int, words binary")


def encode_words(words: DataFrame, model: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """block, part and the packed ids of the part's words: how many each has, then all."""
    letters = {b: chr(c) for c, b in byte_letters().items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        tokenize = tokenizer.model.tokenize
        added = {t.encode(): [n] for t, n in added_tokens(tokenizer).items()}
        table: dict[bytes, list[int]] = dict(added)
        for batch in batches:
            out = []
            for body in batch.column("words"):
                sizes, joined = unpack(body.as_py())
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                counts, ids, at = [], [], 0
                for end in ends:
                    word = joined[at:end]
                    found = table.get(word)
                    if found is None:
                        piece = word.decode("latin-1").translate(letters)
                        found = table[word] = [t.id for t in tokenize(piece)]
                    counts.append(len(found))
                    ids += found
                    at = end
                if len(table) > table_words:
                    table = dict(added)
                out.append(pack(np.array(counts, dtype=np.int64), pack(np.array(ids, dtype=np.int64))))
            columns = [batch.column("block"), batch.column("part"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "ids"])

    return words.mapInArrow(run, "block bigint, part int, ids binary")


def piece_table(model: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces one after the other, and the number of bytes of each id."""
    letters = byte_letters()
    vocabulary = load(model).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece.translate(letters).encode("latin-1")
    return np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], dtype=np.int64)


def gather(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join runs of ``values`` (of the given lengths) to the numbers ``at``, and where each ends."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[at]
    ends = np.cumsum(taken)
    place = np.repeat(starts[at] - (ends - taken), taken) + np.arange(int(taken.sum()))
    return values[place], ends


def portions(counts: np.ndarray, words: int = 1 << 17) -> Iterator[tuple[int, int, int]]:
    """Documents [low, high) of a block by about so many words, and where their words start."""
    ends = np.cumsum(counts)
    low, at = 0, 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, at + words, side="right")))
        yield low, high, at
        low, at = high, int(ends[high - 1])


def encode_decode(
    docs: DataFrame, path: str, block_words: int = BLOCK_WORDS, parts: int | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit) and decoded text of every row.

    ``path`` is the tokenizer's file, read here and sent to the tasks. ``parts`` is the
    number of parts into which distinct words are dealt, by default that of the shuffles.
    """
    with open(path, encoding="utf-8") as file:
        model = file.read()
    kind = dict(docs.dtypes)["doc_id"]
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks(docs, model, parts, block_words).repartition("block")
    coded = encode_words(part_words(found).repartition("part"), model)
    known = coded.groupBy("block").agg(F.collect_list(F.struct("part", "ids")).alias("coded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, piece_lengths = piece_table(model)
        for batch in batches:
            for row in range(batch.num_rows):
                positions, part = (unpack(batch.column(c)[row].as_py())[0] for c in ("positions", "part"))
                each = sorted((c["part"], c["ids"]) for c in batch.column("coded")[row].as_py())
                sizes, ids = [], []
                for _, body in each:
                    counts, rest = unpack(body)
                    sizes.append(counts)
                    ids.append(unpack(rest)[0])
                # Words stand part by part here; their numbers go by frequency.
                order = np.argsort(part, kind="stable")
                by_part = np.empty(len(part), dtype=np.int64)
                by_part[order] = np.arange(len(part))
                lengths = np.concatenate(sizes).astype(np.int64)
                every, where = np.concatenate(ids), by_part[positions]
                doc_ids = batch.column("ids")[row].values
                counts = np.array(batch.column("counts")[row].values, dtype=np.int64)
                for low, high, at in portions(counts):
                    part_counts = counts[low:high]
                    words = where[at : at + int(part_counts.sum())]
                    tokens, ends = gather(every, lengths, words)
                    octets, octet_ends = gather(pieces, piece_lengths, tokens)
                    last = np.cumsum(part_counts)
                    cut = np.concatenate([[0], ends])[np.concatenate([[0], last])]
                    octet_cut = np.concatenate([[0], octet_ends])[cut]
                    raw, text = tokens.astype("<u4").tobytes(), octets.tobytes()
                    decoded = [text[a:b].decode("utf-8", "replace") for a, b in pairwise(octet_cut.tolist())]
                    columns = [
                        doc_ids.slice(low, high - low),
                        pa.array(np.diff(cut)),
                        pa.array([raw[4 * a : 4 * b] for a, b in pairwise(cut.tolist())], pa.binary()),
                        pa.array(decoded, pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    # A left join, and all columns to the end: with a filter or fewer columns on this side,
    # the blocks would be made and shuffled a second time.
    joined = found.join(known, "block", "left").select("ids", "counts", "positions", "part", "coded", "words")
    return joined.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
