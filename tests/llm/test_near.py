"""Near copies of the pipeline: five-word likeness, against comparing all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lapstream.llm import near, simhash
from tests.llm import brute


def classes(root):
    found: dict = {}
    for i, r in root.items():
        found.setdefault(r, set()).add(i)
    return sorted(map(sorted, found.values()))


def test_stage_keeps_one_of_each_near_copy(spark, make, sf_dir):
    draw = random.Random(8)
    rows = []
    for family in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        rows.append((10 * family, " ".join(words)))
        for copy, edits in enumerate((1, 3, 12), 1):
            changed = list(words)
            for at in range(edits):
                changed[at * 200 // edits] = f"new{copy}x{at}"
            rows.append((10 * family + copy, "  ".join(changed).upper()))
    texts = dict(rows)
    links = [(a, b) for a, b in combinations(texts, 2) if brute.likeness(texts[a], texts[b]) >= 0.8]
    want = brute.roots(texts, links)
    assert any((brute.fingerprint(texts[a]) ^ brute.fingerprint(texts[b])).bit_count() > 2 for a, b in links)
    docs = make(rows)
    found = {r.doc_id: r.root for r in near.near_copies(docs, leaf=16).collect()}
    assert classes(found) == classes(want)
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_copies_of_documents(spark, documents, texts):
    found = {r.doc_id: r.root for r in near.near_copies(documents).collect()}
    wordy = [i for i, t in texts.items() if brute.WORDS.search(t[0] or "")]
    links = [(a, b) for a, b in combinations(wordy, 2) if brute.likeness(texts[a][0], texts[b][0]) >= 0.8]
    want = brute.roots(wordy, links)
    assert any(texts[a][0].lower() != texts[b][0].lower() for a, b in links)
    assert classes({i: found[i] for i in wordy}) == classes(want)


def test_sketch_follows_likeness():
    draw = random.Random(2)
    for share in (0.5, 0.8, 0.95):
        same, other = int(3000 * share), int(3000 * (1 - share) / 2)
        pool = np.array([draw.getrandbits(64) for _ in range(same + 2 * other)], dtype=np.uint64)
        pairs = zip(near.sketch(pool[: same + other]), near.sketch(np.delete(pool, range(same, same + other))), strict=True)
        differ = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in pairs)
        assert abs(1 - 2 * differ / near.SKETCH - share) < 0.2


def test_bits_are_turned_and_turned_back():
    codes = np.array([random.Random(i).getrandbits(64) for i in range(50)], dtype=np.uint64)
    order = near.TURNS[3]
    there = near.turned(codes, order)
    assert np.array_equal(np.bitwise_count(there), np.bitwise_count(codes))
    assert np.array_equal(near.turned(there, np.argsort(order)), codes)
    assert simhash.BITS == len(set(order.tolist()))


def family_rows(draw, members, words, edits):
    """A base text and copies of it with words replaced at random places."""
    base = [f"b{draw.randrange(10**6)}" for _ in range(words)]
    rows = []
    for _ in range(members):
        text = list(base)
        for at in draw.sample(range(words), edits):
            text[at] = f"e{draw.randrange(10**6)}"
        rows.append(" ".join(text))
    return rows


@pytest.mark.parametrize("edits", [2, 3, 4])
def test_large_family_is_judged_whole(make, monkeypatch, edits):
    """Likeness just above and below 0.8 in one family of several blocks: no link is lost, and links
    stay about as many as members."""
    monkeypatch.setattr(near, "BLOCK_NODES", 24)
    draw = random.Random(edits)
    texts = dict(enumerate(family_rows(draw, 150, 120, edits) + family_rows(draw, 30, 60, 1)))
    links = [(a, b) for a, b in combinations(texts, 2) if brute.likeness(texts[a], texts[b]) >= 0.8]
    want = classes(brute.roots(texts, links))
    found = {r.doc_id: r.root for r in near.near_copies(make(list(texts.items())), leaf=16).collect()}
    got = classes(found)
    # Candidates are found by chance: of the links of brute force, 99 in 100 at least are inside a class.
    part = {i: n for n, c in enumerate(got) for i in c}
    whole = {i: n for n, c in enumerate(want) for i in c}
    assert sum(part[a] == part[b] for a, b in links) >= 0.99 * len(links)
    assert all(len({whole[i] for i in c}) == 1 for c in got)


def test_odd_rows_of_one_node(make):
    rows = [(1, "a b c d e f"), (None, "A  b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, " \t"), (4, "x"), (5, "X")]
    found = near.near_copies(make(rows, ("node_id", "code", "label", "block", "part", "n", "u", "v")))
    ids = [[str(r.doc_id) for r in found.collect() if r.root == root] for root in {r.root for r in found.collect()}]
    assert sorted(map(sorted, ids)) == [["1", "1", "None"], ["2", "3", "None"], ["4", "5"]]


def test_long_texts_have_a_block_each(make, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 1000)
    draw = random.Random(11)
    texts = dict(enumerate(family_rows(draw, 5, 4000, 9)))
    found = near.near_copies(make(list(texts.items()))).collect()
    assert len({r.root for r in found}) == 1


def test_common_counts_all_pairs(monkeypatch):
    monkeypatch.setattr(near, "COLUMNS", 7)
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 60, 12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    # With itself a set is not compared.
    np.fill_diagonal(want, 0)
    found = near.common(sets, 5)
    np.fill_diagonal(found, 0)
    assert (found == want).all()
    assert (near.common(sets, 2) == want[:2, 2:]).all()
