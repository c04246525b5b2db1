"""Secret scans: fixed patterns, and formats inferred from what they find.

Base matches are leftmost and do not overlap within their kind. The values they hold are
the labelled credentials. For each kind a prefix tree of its values, over classes of
characters, is folded into a probabilistic automaton: states whose endings and next
symbols agree within Hoeffding's bound, and all states below them, are merged. Every run
of value characters in a text is then scored; it is a secret of inferred format if an
automaton gives it at least the likelihood per symbol that nearly all labelled values
reach, and ordinary words explain it less well. Its length counts by the chances of ending
alone: formats of unseen lengths are judged like any other.

Automata are fitted on at most ``FIT_VALUES`` distinct values per kind, chosen by hash
from all documents. Scans cover whole texts. NULL counts as empty. Repeated rows come back
as often as they occur. With no values of a kind there is no automaton for it. An empty
table gives an empty result. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapstream.session import cut_lineage

KINDS = ("assign", "access", "hex")
FIT_VALUES = 500
FIT_WORDS = 5000
#: Longer values are scored, but take no part in the fit.
FIT_CHARS = 4096
ALPHA = 0.05
UNSEEN = 1e-4
REACHED_BY = 0.02
SHORTEST = 6
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)

Span = tuple[int, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end, value) of the fixed patterns, in order."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of hexadecimal digits matches from its start, so a minimum length drops the same runs.
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def symbol(char: str) -> str:
    """Class of a value character."""
    if char.isdigit():
        return "0"
    if "a" <= char <= "f":
        return "a"
    if "g" <= char <= "z":
        return "g"
    if "A" <= char <= "F":
        return "A"
    if "G" <= char <= "Z":
        return "G"
    return char


@dataclass
class Automaton:
    """Probabilistic automaton: per state its transitions and the log chances of them and
    of ending; what a value must reach to pass."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    least: float = 0.0

    def per_symbol(self, value: str) -> float:
        state, total = 0, 0.0
        for char in value:
            state, chance = self.steps[state].get(symbol(char), (-1, 0.0))
            if state < 0:
                return math.log(UNSEEN)
            total += chance
        return (total + self.ends[state]) / (len(value) + 1)


class Tree:
    """Prefix tree of values, with how often each edge is passed and each node is an end."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ended = [0]
        for value in values:
            node = 0
            for s in map(symbol, value):
                at = self.next[node].get(s)
                if at is None:
                    at = self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ended.append(0)
                self.count[node][s] = self.count[node].get(s, 0) + 1
                node = at
            self.ended[node] += 1

    def passed(self, node: int) -> int:
        return self.ended[node] + sum(self.count[node].values())

    def agree(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states, and all that follows both, differ by chance only."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.passed(a), self.passed(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / n - self.count[b].get(s, 0) / m) > bound:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, into: int, node: int) -> None:
        """Add a subtree that nothing points to any more to a state."""
        todo = [(into, node)]
        while todo:
            into, node = todo.pop()
            self.ended[into] += self.ended[node]
            for s, n in self.count[node].items():
                self.count[into][s] = self.count[into].get(s, 0) + n
                child = self.next[node][s]
                at = self.next[into].setdefault(s, child)
                if at != child:
                    todo.append((at, child))


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree, breadth first."""
    tree = Tree(sorted(values))
    kept = [0]
    while True:
        known = set(kept)
        fringe = [(p, s) for p in kept for s in sorted(tree.next[p]) if tree.next[p][s] not in known]
        if not fringe:
            break
        parent, s = fringe[0]
        node = tree.next[parent][s]
        for state in kept:
            if tree.agree(state, node, alpha):
                tree.next[parent][s] = state
                tree.fold(state, node)
                break
        else:
            kept.append(node)
    place = {node: i for i, node in enumerate(kept)}
    steps, ends = [], []
    for node in kept:
        whole = max(tree.passed(node), 1)
        steps.append({s: (place[tree.next[node][s]], math.log(n / whole)) for s, n in tree.count[node].items()})
        ends.append(math.log(max(tree.ended[node] / whole, UNSEEN)))
    return Automaton(steps, ends)


@dataclass
class Words:
    """How likely ordinary runs are: chances of a class of characters after another."""

    chances: dict[tuple[str, str], float]

    def per_symbol(self, value: str) -> float:
        line = [""] + [symbol(c) for c in value] + [""]
        least = math.log(UNSEEN)
        return sum(self.chances.get(p, least) for p in zip(line, line[1:], strict=False)) / (len(line) - 1)


def ordinary(words: list[str]) -> Words:
    pairs: dict[tuple[str, str], int] = {}
    first: dict[str, int] = {}
    for word in words:
        line = [""] + [symbol(c) for c in word] + [""]
        for pair in zip(line, line[1:], strict=False):
            pairs[pair] = pairs.get(pair, 0) + 1
            first[pair[0]] = first.get(pair[0], 0) + 1
    return Words({p: math.log(n / first[p[0]]) for p, n in pairs.items()})


@dataclass
class Formats:
    """One automaton per kind that has values, and the ordinary runs."""

    automata: list[Automaton]
    words: Words

    def passes(self, value: str) -> bool:
        usual: float | None = None
        for automaton in self.automata:
            score = automaton.per_symbol(value)
            if score >= automaton.least:
                usual = self.words.per_symbol(value) if usual is None else usual
                if score > usual:
                    return True
        return False


def formats_of(values: dict[str, list[str]], words: list[str]) -> Formats:
    automata = []
    for kind in KINDS:
        own = sorted(set(values.get(kind, ())))
        if len(own) < 2:
            continue
        automaton = infer(own)
        scores = sorted(automaton.per_symbol(v) for v in own)
        automaton.least = scores[int(REACHED_BY * len(scores))]
        automata.append(automaton)
    return Formats(automata, ordinary(words))


def labelled(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of base matches, and distinct runs of value characters
    outside them as kind ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text in batch.column("text"):
                body = text.as_py() or ""
                base = base_spans(body)
                found.update((KINDS[k], v) for _, k, _, v in base)
                found.update(("word", body[a:b]) for a, b in outside(body, base))
            kinds = pa.array([k for k, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([kinds, pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def outside(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Candidates: runs of value characters that no base match touches."""
    cover = sorted((start, end) for start, _, end, _ in base)
    at = 0
    for found in RUN.finditer(text):
        start, end = found.span()
        while at < len(cover) and cover[at][1] <= start:
            at += 1
        if at == len(cover) or cover[at][0] >= end:
            yield start, end


def learn(docs: DataFrame, fit_values: int = FIT_VALUES, fit_words: int = FIT_WORDS) -> Formats:
    """Automata from a bounded sample of the distinct values of all documents."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = cut_lineage(labelled(texts).filter(F.length("value") <= FIT_CHARS), "secrets-values")
    # Each draw keeps the values with the smallest hashes, in every task first.
    draw = [F.xxhash64("value"), F.col("value")]
    values = {
        kind: [r["value"] for r in found.filter(F.col("kind") == kind).orderBy(*draw).limit(most).collect()]
        for kind, most in [*((k, fit_values) for k in KINDS), ("word", fit_words)]
    }
    return formats_of(values, sorted(values["word"]))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, counts per base kind, base spans and all spans (kind:start:end, ...)."""
    kind = dict(docs.dtypes)["doc_id"]

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{(*KINDS, 'format')[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            base_out, all_out = [], []
            for text in batch.column("text"):
                body = text.as_py() or ""
                base = base_spans(body)
                for k in range(3):
                    counts[k].append(sum(b[1] == k for b in base))
                spans = [b[:3] for b in base]
                more = [(a, 3, b) for a, b in outside(body, base) if formats.passes(body[a:b])]
                base_out.append(line(spans))
                all_out.append(line(sorted(spans + more)) if more else base_out[-1])
            columns = [
                batch.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array(base_out, pa.string()),
                pa.array(all_out, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    )


def find_secrets(docs: DataFrame, fit_values: int = FIT_VALUES, fit_words: int = FIT_WORDS) -> DataFrame:
    return scan(docs, learn(docs, fit_values, fit_words))
