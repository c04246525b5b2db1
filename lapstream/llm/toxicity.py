"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are per document. Words and word beginnings that stand in toxic documents far more
often than in others label the tokens of toxic documents; tokens of other documents are
labelled clean. A two-state chain with word and prefix features is fitted to these tokens
by gradient steps on its exact likelihood. Forward-backward gives each token's chance of
being toxic; their sum and maximum and the length of the text go into a logistic score.

The fit uses at most ``FIT_DOCS`` labelled documents of either label, chosen by a hash of
their ids, and runs once on the driver; near copies among them count once. Scoring covers
whole texts of all documents in the tasks, many documents at a time.

NULL and empty texts have no tokens and get the score of an empty text. Without documents
of both labels the score is the share of toxic ones, 0 if there is none. Repeated rows are
scored alike. Of several labels of one id the highest counts. A NULL id counts as empty
text for the split. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.llm.common import crc_bucket

FIT_DOCS = 3000
PREFIXES = (2, 3, 4, 5, 6, 7)
AROUND = 12
STEPS = 60
PIECE_CHARS = 1 << 21
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    low = word.lower()
    return [low + "$"] + [low[:n] for n in PREFIXES if len(low) >= n]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    chain: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)
    judge: tuple[float, ...] | None = None
    share: float = 0.0

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def marginals(emission: np.ndarray, lengths: np.ndarray, chain: tuple[float, ...]) -> np.ndarray:
    """Chance of the toxic state at every token of several texts, one after the other.

    Forward and backward keep the ratio of the two states, over all texts at once; texts
    are taken by falling length, so those still running are a prefix.
    """
    out = np.zeros(len(emission))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), side="left")
    force = np.exp(np.clip(emission, -30, 30))
    ahead = np.empty(len(emission))
    a00, a01, a10, a11 = chain
    ratio = np.ones(0)
    for t in range(longest):
        at = starts[: running[t]] + t
        before = ratio[: running[t]] if t else None
        ratio = force[at] if t == 0 else force[at] * (a01 + a11 * before) / (a00 + a10 * before)
        ahead[at] = ratio
    back = np.ones(len(size))
    for t in range(longest - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        more = running[t + 1] if t + 1 < longest else 0
        if more:
            push = force[at[:more] + 1] * back[:more]
            back[:more] = (a10 + a11 * push) / (a00 + a01 * push)
        both = ahead[at] * back[:n]
        out[at] = both / (1 + both)
    return out


def seeds(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that stand in toxic documents at three times the rate elsewhere, or more,
    with confidence."""
    counts = (Counter(), Counter())
    total = [0, 0]
    for words, toxic in docs:
        total[toxic] += 1
        counts[toxic].update({f for w in set(words) for f in features(w)})
    found = set()
    for feature, hits in counts[1].items():
        if hits < 3:
            continue
        others = counts[0][feature]
        ratio = math.log((hits + 0.5) / (total[1] + 1)) - math.log((others + 0.5) / (total[0] + 1))
        if ratio - 1.64 * math.sqrt(1 / (hits + 0.5) + 1 / (others + 0.5)) > math.log(3):
            found.add(feature)
    return found


def segments(docs: list[tuple[list[str], int]], marked: set[str]) -> list[tuple[list[str], list[int]]]:
    """Stretches of labelled tokens: around each marked token, and the start of each text."""
    out = []
    for words, toxic in docs:
        hits = [i for i, w in enumerate(words) if any(f in marked for f in features(w))]
        spans: list[list[int]] = [[0, min(len(words), 2 * AROUND)]]
        for i in hits:
            low, high = max(0, i - AROUND), min(len(words), i + AROUND + 1)
            if low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        hit = set(hits) if toxic else set()
        out += [(words[a:b], [int(i in hit) for i in range(a, b)]) for a, b in spans if b > a]
    return out


def fit_chain(parts: list[tuple[list[str], list[int]]]) -> Model:
    """Exact-likelihood gradient ascent (Adam) with an L2 penalty."""
    seen = Counter(f for words, _ in parts for w in words for f in features(w))
    number = {f: i for i, f in enumerate(f for f, n in seen.items() if n > 1)}
    flat_f: list[int] = []
    flat_t: list[int] = []
    lengths = np.array([len(w) for w, _ in parts])
    token = 0
    for words, _ in parts:
        for word in words:
            own = [number[f] for f in features(word) if f in number]
            flat_f += own
            flat_t += [token] * len(own)
            token += 1
    where, what = np.array(flat_t, dtype=np.int64), np.array(flat_f, dtype=np.int64)
    label = np.array([y for _, ys in parts for y in ys], dtype=np.float64)
    first = np.cumsum(lengths) - lengths
    linked = np.ones(token, dtype=bool)
    linked[first] = False
    later = np.flatnonzero(linked)
    pair = (2 * label[later - 1] + label[later]).astype(int)
    theta = np.zeros(len(number) + 5)
    theta[len(number)] = -2.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, bias, log_chain = theta[: len(number)], theta[len(number)], theta[len(number) + 1 :]
        emission = bias + np.bincount(where, weights[what], minlength=token)
        chain = np.exp(log_chain)
        chance = marginals(emission, lengths, tuple(chain))
        # A pair's chances follow from the two ends: condition the later state on the earlier.
        ratio_ahead, ratio_back = end_ratios(emission, lengths, tuple(chain))
        r, q = ratio_ahead[later - 1], np.exp(np.clip(emission[later], -30, 30)) * ratio_back[later]
        joint = np.stack([np.full_like(r, chain[0]), chain[1] * q, chain[2] * r, chain[3] * r * q])
        joint /= joint.sum(axis=0)
        off = label - chance
        slope = np.empty_like(theta)
        slope[: len(number)] = np.bincount(what, off[where], minlength=len(number)) - 0.05 * weights
        slope[len(number)] = off.sum()
        slope[len(number) + 1 :] = np.bincount(pair, minlength=4) - joint.sum(axis=1) - 0.5 * log_chain
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    names = list(number)
    kept = {names[i]: float(w) for i, w in enumerate(theta[: len(number)]) if abs(w) > 0.02}
    return Model(kept, float(theta[len(number)]), tuple(np.exp(theta[len(number) + 1 :]).tolist()))


def end_ratios(emission: np.ndarray, lengths: np.ndarray, chain: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of the states given the tokens up to each one, and given those after it."""
    a00, a01, a10, a11 = chain
    force = np.exp(np.clip(emission, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    starts, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), side="left")
    ahead, back = np.ones(len(emission)), np.ones(len(emission))
    for t in range(longest):
        at = starts[: running[t]] + t
        ahead[at] = force[at] if t == 0 else force[at] * (a01 + a11 * ahead[at - 1]) / (a00 + a10 * ahead[at - 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        push = force[at + 1] * back[at + 1]
        back[at] = (a10 + a11 * push) / (a00 + a01 * push)
    return ahead, back


def summary(chance: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the score of a text is made from: a one, log of the expected number of toxic
    tokens, log odds of the likeliest one, log of the length."""
    out = np.zeros((len(lengths), 4))
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        part = chance[a:b]
        top = min(max(float(part.max(initial=0.0)), 1e-4), 1 - 1e-4)
        out[i] = (1.0, math.log(float(part.sum()) + 1e-2), math.log(top / (1 - top)), math.log(b - a + 1))
    return out


def fit_judge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps with a light penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return tuple(w.tolist())


def score_words(model: Model, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of tokenised texts, token chances and token counts."""
    known: dict[str, int] = {}
    number = np.array([known.setdefault(w, len(known)) for words in texts for w in words], dtype=np.int64)
    strength = np.array([model.emission(w) for w in known])
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    chance = marginals(strength[number] if len(number) else np.zeros(0), lengths, model.chain)
    if model.judge is None:
        return np.full(len(texts), model.share), chance, lengths
    x = summary(chance, lengths) @ np.array(model.judge)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), chance, lengths


def fit(rows: list[tuple[str, int]], totals: tuple[int, int]) -> Model:
    """Model from (text, toxic) rows; ``totals`` are all clean and all toxic documents."""
    docs, seen = [], set()
    for text, toxic in rows:
        ends = {("head", text[:80]), ("tail", text[-80:])}
        if not ends & seen:
            seen |= ends
            docs.append((TOKEN.findall(text), toxic))
    share = totals[1] / sum(totals) if sum(totals) else 0.0
    y = np.array([toxic for _, toxic in docs], dtype=np.float64)
    parts = segments(docs, seeds(docs)) if len(docs) else []
    if not parts or not 0 < y.sum() < len(y):
        return Model(share=share)
    model = fit_chain(parts)
    model.share = share
    words = [w for w, _ in docs]
    chance, lengths = [], []
    for at in range(0, len(words), 200):
        _, c, n = score_words(model, words[at : at + 200])
        chance.append(c)
        lengths.append(n)
    x = summary(np.concatenate(chance), np.concatenate(lengths))
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    model.judge = fit_judge(x, y, weight * len(y) / sum(totals))
    return model


def is_held_out(buckets: int = 5, held: int = 0):
    return crc_bucket(F.col("doc_id"), buckets) == held


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    marked = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [
        r for toxic in (0, 1) for r in marked.filter(F.col("toxic") == toxic).orderBy(*draw).limit(fit_docs).collect()
    ]
    chosen = docs.sparkSession.createDataFrame(picked, marked.schema)
    # At most twice fit_docs ids are sent around.
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "toxic", "doc_id")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([(r["text"], r["toxic"]) for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic spans (start:end, ...) of every text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            texts = batch.column("text")
            while low < batch.num_rows:
                part, size = [], 0
                while low + len(part) < batch.num_rows and size < PIECE_CHARS:
                    part.append(texts[low + len(part)].as_py() or "")
                    size += len(part[-1])
                score, chance, lengths = score_words(model, [TOKEN.findall(t) for t in part])
                spans = []
                ends = np.cumsum(lengths)
                for text, a, b in zip(part, ends - lengths, ends, strict=True):
                    hits = set(np.flatnonzero(chance[a:b] >= 0.5).tolist())
                    spans.append(
                        ",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(TOKEN.finditer(text)) if i in hits)
                        if hits
                        else ""
                    )
                columns = [
                    batch.column("doc_id").slice(low, len(part)),
                    batch.column("held_out").slice(low, len(part)),
                    pa.array(score, pa.float64()),
                    pa.array((score >= 0.5).astype(np.int32)),
                    pa.array(spans, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "spans"])
                low += len(part)

    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")


def detect(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    return predict(docs, learn(docs, labels, fit_docs))
