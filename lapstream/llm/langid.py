"""Language ID by hyperdimensional profiles.

Every letter gets a random vector of +1 and -1 drawn from its code point. A three-letter
sequence is the product of its letters' vectors, the second rotated by one place and the
third by two. A text is the sum over its sequences, a language the sum over its training
texts, and a text gets the language whose sum has the largest cosine with its own.

Sequences are taken over letters in lower case with one blank for anything between them.
Language sums are added up per task and merged by aggregation; they cover all training
rows. What is sent to the tasks is one vector per language, and the number of languages
is checked against ``MAX_LANGUAGES``.

A text that is NULL or has no letter gets ``und`` and score 0, as does every text when
there is nothing to learn from. As a filter (``accepted``) it also rejects texts that are not
near any language, by a floor for the cosine learned from the training rows. Ties go to the first language by code point. A NULL id
counts as empty text for the split. Long texts are taken in pieces, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.llm.common import crc_bucket

DIMENSIONS = 1024
SEED = 20240229
MAX_LANGUAGES = 8192
PIECE_CHARS = 1 << 20
PIECE_DOCS = 256
SEQUENCES_AT_ONCE = 4096
#: A text is rejected below this share of this quantile of the training cosines.
QUANTILE, FLOOR_SHARE = 0.001, 0.5
FLOOR_ROWS = 500
#: Standard deviation of the cosine of unrelated vectors: no nearer than this is not near.
CHANCE = DIMENSIONS**-0.5
POWERS = 48

_letters: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        draw = np.random.Generator(np.random.Philox(key=SEED + code))
        _letters[code] = (draw.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _letters[code]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and lower-case texts, in portions of bounded size.

    A text longer than a portion is taken in several pieces; a cut acts as a blank.
    """
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for start in range(0, max(len(low), 1), PIECE_CHARS):
            part = low[start : start + PIECE_CHARS]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= PIECE_CHARS or len(rows) >= PIECE_DOCS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def sequences(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all sequences of some texts: text number, number of the sequence, and the
    distinct sequences as rows of three code points."""
    joined = "\n".join(parts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, dtype=np.uint32)
    text = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])[: len(codes)]
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    known = np.array([0] + [c for c in present.tolist() if chr(c).isalpha()], dtype=np.int64)
    table = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int64)
    table[known[1:]] = np.arange(1, len(known))
    letter = table[codes]
    keep = letter != 0
    keep[1:] |= letter[:-1] != 0
    letter, text = letter[keep], text[keep]
    # Blanks on both sides, so that a text of one letter has a sequence as well.
    letter = np.concatenate([[0], letter, [0]])
    text = np.concatenate([text[:1], text, text[-1:]])
    middle = letter[1:-1] != 0
    left = np.where(text[:-2] == text[1:-1], letter[:-2], 0)[middle]
    right = np.where(text[2:] == text[1:-1], letter[2:], 0)[middle]
    size = len(known)
    number = (left * size + letter[1:-1][middle]) * size + right
    text = text[1:-1][middle]
    if size**3 <= 1 << 22:
        distinct = np.flatnonzero(np.bincount(number, minlength=1))
        place = np.zeros(size**3, dtype=np.int64)
        place[distinct] = np.arange(len(distinct))
        inverse = place[number]
    else:
        distinct, inverse = np.unique(number, return_inverse=True)
    three = np.stack([distinct // (size * size), distinct // size % size, distinct % size], axis=1)
    return text, inverse, np.where(three == 0, 32, known[three])


def bundle(
    owner: np.ndarray, owners: int, inverse: np.ndarray, three: np.ndarray, seen: np.ndarray | None = None
) -> np.ndarray:
    """Sum of the sequence vectors of each owner; ``seen`` gains its number of distinct sequences."""
    out = np.zeros((owners, DIMENSIONS), dtype=np.float32)
    for low in range(0, len(three), SEQUENCES_AT_ONCE):
        part = three[low : low + SEQUENCES_AT_ONCE]
        near = (inverse >= low) & (inverse < low + len(part))
        counts = np.bincount(
            owner[near] * len(part) + inverse[near] - low, minlength=owners * len(part)
        ).reshape(owners, len(part))
        if seen is not None:
            seen += (counts > 0).sum(axis=1)
        codes, at = np.unique(part, return_inverse=True)
        at = at.reshape(part.shape)
        vectors = np.stack([letter_vector(int(c)) for c in codes])
        bound = vectors[at[:, 0]]
        bound = bound * np.roll(vectors, 1, axis=1)[at[:, 1]]
        bound = bound * np.roll(vectors, 2, axis=1)[at[:, 2]]
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def learn(docs: DataFrame, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and their unit vectors, from rows with text and lang."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for rows, parts in pieces(batch["text"].tolist()):
                text, inverse, three = sequences(parts)
                names = sorted({langs[r] for r in rows})
                owner = np.array([names.index(langs[r]) for r in rows])
                found = bundle(owner[text], len(names), inverse, three)
                for name, vector in zip(names, found, strict=True):
                    total[name] = total.get(name, 0) + vector.astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    rows = (
        docs.select("lang", "text")
        .filter("lang is not null and text is not null")
        .mapInPandas(sums, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("place", "v"))
        .groupBy("lang", "place")
        .agg(F.sum("v").alias("v"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("v"))
        .limit(max_languages + 1)
        .collect()
    )
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    rows.sort(key=lambda r: r["lang"])
    profile = np.array([[x["v"] for x in r["v"]] for r in rows]).reshape(len(rows), DIMENSIONS)
    norm = np.linalg.norm(profile, axis=1, keepdims=True)
    return [r["lang"] for r in rows], (profile / np.where(norm == 0, 1, norm)).astype(np.float32)


def classify(
    texts: list[str | None], langs: list[str], profile: np.ndarray
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and number of distinct sequences (of its richest piece) of each text."""
    vectors: dict[int, np.ndarray] = {}
    best = ["und"] * len(texts)
    score = np.zeros(len(texts))
    size = np.zeros(len(texts), dtype=np.int64)

    def settle(rows: list[int], found: np.ndarray) -> None:
        norm = np.linalg.norm(found, axis=1)
        cosine = (found @ profile.T) / np.where(norm == 0, 1, norm)[:, None]
        top = cosine.argmax(axis=1)
        for place, row in enumerate(rows):
            if norm[place] > 0:
                best[row] = langs[top[place]]
                score[row] = min(1.0, max(0.0, float(cosine[place, top[place]])))

    if not langs:
        return best, score, size
    for rows, parts in pieces(texts):
        text, inverse, three = sequences(parts)
        if not len(text):
            continue
        seen = np.zeros(len(parts), dtype=np.int64)
        found = bundle(text, len(parts), inverse, three, seen)
        np.maximum.at(size, np.array(rows), seen)
        # A text that may be in several pieces is judged once all of them are added up.
        several = {r for r in rows if len(texts[r] or "") >= PIECE_CHARS // 4}
        for place, row in enumerate(rows):
            if row in several:
                vectors[row] = vectors.get(row, 0) + found[place]
        single = [p for p, r in enumerate(rows) if r not in several]
        if single:
            settle([rows[p] for p in single], found[single])
    if vectors:
        settle(list(vectors), np.stack(list(vectors.values())))
    return best, score, size


def is_held_out(buckets: int = 4, held: int = 2):
    return crc_bucket(F.col("doc_id"), buckets) == held


def predict(docs: DataFrame, langs: list[str], profile: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, _ = classify(batch.column("text").to_pylist(), langs, profile)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    return predict(docs, *learn(docs.filter(~is_held_out())))


def floors(
    docs: DataFrame,
    langs: list[str],
    profile: np.ndarray,
    quantile: float = QUANTILE,
    share: float = FLOOR_SHARE,
    rows: int = FLOOR_ROWS,
) -> np.ndarray:
    """Least cosine of an accepted text by the power of two of its distinct sequences.

    It is ``share`` of a low quantile over all training rows with as many distinct sequences
    whose language is found. A size with fewer than ``rows`` of them takes the floor of the next
    smaller size, and 0 where there is none: too little is known to reject.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, size = classify(batch.column("text").to_pylist(), langs, profile)
            own = pa.array([a == b for a, b in zip(best, batch.column("lang").to_pylist(), strict=True)], pa.bool_())
            columns = [pa.array(power(size)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in columns], ["power", "score"])

    known = docs.filter("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    low = F.percentile_approx("score", F.lit(quantile), F.lit(10_000))
    found = known.mapInArrow(run, "power int, score double").groupBy("power").agg(low.alias("low"), F.count(F.lit(1)).alias("n"))
    # A row per power of two at most.
    lows = {r["power"]: share * r["low"] for r in found.collect() if r["n"] >= rows}
    least, last = np.zeros(POWERS), 0.0
    for at in range(POWERS):
        least[at] = last = lows.get(at, last)
    return least


def power(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int32), POWERS - 1)


def accepted(
    docs: DataFrame, quantile: float = QUANTILE, share: float = FLOOR_SHARE, rows: int = FLOOR_ROWS
) -> DataFrame:
    """Whole rows in a language that was learned: those that have a letter and are as near to
    their language as ``floors`` asks of texts of their size."""
    training = docs.filter(~is_held_out())
    langs, profile = learn(training)
    least = floors(training, langs, profile, quantile, share, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, size = classify(batch.column("text").to_pylist(), langs, profile)
            keep = (np.array(best, dtype=object) != "und") & (score >= np.maximum(least[power(size)], CHANCE))
            yield batch.filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
