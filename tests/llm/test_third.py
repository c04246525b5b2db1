"""Packing, collocations and the conversation trie."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapstream.llm import packing, phrases, queries, trie
from tests.llm import brute
from tests.sidebyside import differences, oracle

CLASHES = ("item", "length", "bin", "shard", "place", "word", "n", "f", "block", "row", "at")
PATH = public_tokenizers.path(queries.TOKENIZER)
LONG = " ".join(f"word{i % 331} the" for i in range(9000))
ODD = [
    (1, "Same text, same text"),
    (1, "Same text, same text"),
    (None, None),
    (None, "x <|endoftext|> y"),
    (3, ""),
    (4, " \t\n"),
    (5, LONG),
    (6, "日本語 и кириллица 12³ ½ é \x00   it's"),
    (7, "café\xa0naïve\x85 don't  stop"),
]


# packing ------------------------------------------------------------------------


def check_packing(rows, found, capacity=1024):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        low, piece = 0, 0
        high = len(ids) % capacity or capacity
        while low < len(ids):
            crc = zlib.crc32(np.array(ids[low:high], "<u4").tobytes())
            want[(i, piece, low, high - low, crc)] += 1
            low, high, piece = high, high + capacity, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in found) // capacity)


def test_packing_of_documents(spark, sf_dir, texts):
    found = queries.QUERIES["op11_best_fit_packing"](spark, sf_dir).collect()
    used, least = check_packing([(i, t[0]) for i, t in texts.items()], found)
    assert used <= least + 1


def test_packing_of_odd_rows(make):
    found = packing.pack_documents(make(ODD, CLASHES), PATH).collect()
    check_packing(ODD, found)
    assert packing.pack_documents(make([], CLASHES), PATH).count() == 0
    assert check_packing(ODD, packing.pack_documents(make(ODD), PATH, capacity=16).collect(), 16)


def test_encoder_equals_library():
    encode = packing.encoder(open(PATH, encoding="utf-8").read())
    tokenizer = Tokenizer.from_file(PATH)
    draw = random.Random(5)
    alphabet = [*map(chr, range(0x250)), " ", "あ", "\U0001f600", "'s", "'LL", "  ", " a", "<|endoftext|>", "\r\n"]
    for _ in range(400):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_groups_in_rounds_take_no_more_than_best_fit(spark):
    draw = random.Random(2)
    for sizes in (
        [draw.randrange(200, 700) for _ in range(3000)],
        [draw.choice([340, 341, 342, 510, 514, 171]) for _ in range(2500)],
        [draw.randrange(1, 1024) for _ in range(2000)],
    ):
        table = spark.createDataFrame(list(enumerate(sizes)), "item bigint, length bigint").repartition(3)
        rows = packing.group(table, shard=200).collect()
        assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
        assert max(r["round"] for r in rows) >= 1
        fill = Counter()
        for r in rows:
            fill[(r["round"], r["shard"], r["bin"])] += sizes[r["item"]]
        assert max(fill.values()) <= 1024
        whole = packing.packed(np.array(sizes), np.argsort(-np.array(sizes), kind="stable"), 1024)
        assert len(fill) <= int(whole.max()) + 1 + 2


def test_genetic_search_improves_on_best_fit_decreasing():
    # Bins of three that fall apart when the largest go first.
    draw = np.random.default_rng(4)
    sizes = []
    for _ in range(60):
        a, b = draw.integers(260, 420, 2)
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    first = packing.packed(sizes, np.argsort(-sizes, kind="stable"), 1000)
    found = packing.evolved(sizes, [], [1, 2, 3], 1000, 400)
    assert packing.fitness(np.bincount(found[0], weights=sizes)) < packing.fitness(np.bincount(first, weights=sizes))
    scores = [packing.fitness(np.bincount(g, weights=sizes)) for g in found]
    assert scores == sorted(scores) and max(np.bincount(found[0], weights=sizes)) <= 1000
    again = packing.evolved(sizes, [], [1, 2, 3], 1000, 400)
    assert all(np.array_equal(a, b) for a, b in zip(found, again, strict=True))


def test_crossover_injects_whole_bins():
    draw = np.random.Generator(np.random.PCG64(3))
    sizes = draw.integers(100, 600, 200)
    parents = [packed for packed in (packing.packed(sizes, draw.permutation(200), 1024) for _ in range(2))]
    child = packing.crossed(*parents, sizes, 1024, draw)
    assert max(np.bincount(child, weights=sizes)) <= 1024 and len(child) == 200
    bins = [{frozenset(np.flatnonzero(g == b).tolist()) for b in set(g.tolist())} for g in (*parents, child)]
    assert len(bins[0] & bins[2]) >= int(packing.INJECT * len(bins[0]))


# collocations -------------------------------------------------------------------


def plain_phrases(rows, least=10, top=2000):
    one, many = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            one[lang or "und"].update((w,) for w in words)
            for width in (2, 3):
                many[lang or "und"].update(zip(*(words[i:] for i in range(width)), strict=False))
    out = []
    for lang in one:
        f = one[lang] + many[lang]
        held = {p: a for p, a in many[lang].items() if a >= least}
        rows_ = []
        for p, a in held.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in held.items() if p[0] in q):
                continue
            cuts = [(SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(one[lang].values())
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


SCALE = phrases.SCALE


def phrase_rows(seed, count=150):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        words = [f"W{int(draw.paretovariate(0.8)) % 60}" for _ in range(draw.randrange(80))]
        for at in range(0, len(words) - 4, 9):
            words[at : at + 3] = draw.choice([["New", "york", "city"], ["ab", "cd"], ["of", "the", "Éa"], ["q", "q", "q", "q"]])
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ", ", "\n", " ? "]) for w in words)
        rows.append((i, text, draw.choice(["en", "en", "de", None]), None))
    return rows


@pytest.mark.parametrize(("block_words", "top", "floors"), [(1 << 20, 2000, phrases.FLOORS), (37, 40, (600_000, 90_000, 0))])
def test_phrases_equal_plain_counts(make, block_words, top, floors):
    rows = phrase_rows(block_words)
    found = phrases.collocations(make(rows, CLASHES), top=top, floors=floors, block_words=block_words).collect()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[n] for n in names) for r in found) == plain_phrases(rows, top=top)


def test_phrases_match_sql(spark):
    sf_dir, name = "/root/testdata/sf0.01", "op12_collocations"
    assert differences(queries.QUERIES[name](spark, sf_dir), oracle(sf_dir), queries.ORACLES[name]) == []


def test_phrases_of_odd_rows(make):
    rows = [*[(i, "a b c", None, None) for i in range(12)], (1, None), (None, ""), (2, " ,.! \t"), (3, "a b " * 4000, "en", None)]
    found = phrases.collocations(make(rows, CLASHES), block_words=100).collect()
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == plain_phrases(full)
    assert phrases.collocations(make([], CLASHES)).count() == 0


# trie ---------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, said, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for node, convs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        saved = sum((len(members[p]) - 1) * len(brute.WORDS.findall(p[-1][1])) for p in below if p)
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(convs), len(node), parent, len(convs), children[node], sum(not children[p] for p in below), saved, brute.sha(ends))
        )
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(seed, count=70):
    draw = random.Random(seed)
    said = [("user", "hello there"), ("user", ""), ("assistant", "well  well"), (None, None), ("", "a b c")]
    rows = []
    for c in [*range(-25, 30), *draw.sample(range(100, 400), count)]:
        for turn in range(draw.choice([0, 1, 2, 5, 5, 14])):
            rows.append((c, draw.choice([turn, turn, None]), *draw.choice(said[: 2 + turn % 4])))
    rows += [(None, 1, "user", "lost"), *[(400, i, "user", "x y") for i in range(40)], *[(420, i, "user", "x y") for i in range(37)]]
    rows += [(421 + i, k, "user", "x y") for i in range(9) for k in range(9)]
    draw.shuffle(rows)
    return rows


def conversations(spark, rows):
    data = [(*r, "z") for r in rows]
    schema = "conv_id bigint, turn bigint, role string, text string, place string"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.mark.parametrize(("stretch", "shard", "run"), [(1 << 12, 1 << 16, 1 << 13), (4, 50, 2)])
def test_trie_equals_plain(spark, monkeypatch, stretch, shard, run):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(trie, "RUN_IDS", run)
    rows = trie_rows(stretch)
    found = trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == plain_trie(rows)


def test_trie_matches_sql(spark, sf_dir):
    name = "op13_prefix_trie"
    assert differences(queries.QUERIES[name](spark, sf_dir), oracle(sf_dir), queries.ORACLES[name]) == []


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    # crc32("1") % 4 is 3: the only turn is replaced by those of conversation 0, which is absent.
    assert zlib.crc32(b"1") % 4 == 3
    rows = [(1, None, None, None)]
    found = trie.prefix_trie(conversations(spark, rows)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == plain_trie(rows)
    assert found[0].n_leaves == 1 and found[0].ends_sha256 == brute.sha("1")


def test_slot_table_is_minimal_and_verified():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 62, (5000, 2)).astype(np.uint64), axis=0)
    table = trie.SlotTable(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (table.keys[slots] == keys).all()
    other = draw.integers(1 << 62, 1 << 63, (5000, 2)).astype(np.uint64)
    assert (table.slots(other) == -1).all()
    assert len(trie.SlotTable(keys[:0]).keys) == 0
