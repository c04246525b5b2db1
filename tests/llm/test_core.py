"""Exact dedup, language ID, SimHash, mixing, BPE and the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lapstream.llm import bpe, exact, langid, mixing, queries, simhash
from lapstream.llm.common import apply_verdict
from tests.llm import brute
from tests.sidebyside import differences, oracle

CLASHES = ("h", "t", "row", "kept", "code", "block", "x", "size", "source_size", "content", "score", "word")
ODD = [
    (1, "Same Text here"),
    (2, "same text HERE"),
    (None, "same text here"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "Éa same"),
    (6, "Éa same"),
    (7, "éa same"),
    (None, None),
]


def odd(make):
    return make(ODD, CLASHES)


def empty(make):
    return make([], CLASHES)


# exact dedup ------------------------------------------------------------------


def test_exact_matches_sql(spark, sf_dir):
    con = oracle(sf_dir)
    name = "op1_exact_dedup"
    assert differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) == []


def test_exact_on_odd_rows(make):
    rows = exact.find_copies(odd(make), keep="largest").collect()
    assert len(rows) == len(ODD)
    by_text = defaultdict(list)
    for r in rows:
        by_text[r.text_sha256].append(r)
    sizes = {k: len(v) for k, v in by_text.items()}
    assert all(r.group_size == sizes[r.text_sha256] for r in rows)
    assert all(sum(r.kept for r in v) == 1 for v in by_text.values())
    assert {r.keep_id for r in by_text[brute.sha("same text here")]} == {2}
    assert {r.keep_id for r in by_text[brute.sha("")]} == {4}
    assert by_text[brute.sha("Éa same")] and by_text[brute.sha("éa same")]
    assert exact.find_copies(empty(make)).count() == 0


def test_exact_splits_hash_collisions(make):
    rows = [(i, f"text {i % 7}") for i in range(70)]
    found = exact.find_copies(make(rows), hash_of=lambda t: F.unhex(F.md5(F.substring(t, 1, 4)))).collect()
    assert {r.doc_id: r.keep_id for r in found} == {i: i % 7 for i in range(70)}
    assert {r.group_size for r in found} == {10}


def test_exact_verdict_keeps_one_row(make):
    docs = odd(make)
    kept = apply_verdict(docs, exact.verdict_of(exact.find_copies(docs)))
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == Counter({(1, "Same Text here"): 1, (3, None): 1, (5, " \t\n "): 1, (6, "Éa same"): 1, (7, "éa same"): 1})


# language ID ------------------------------------------------------------------


def test_language_of_held_out(spark, sf_dir, texts):
    rows = queries.QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == texts[r.doc_id][1] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundles_add_up_letter_by_letter():
    text = "Abc, d! éÉ x"
    letters = " abc d éé x "
    total = np.zeros(langid.DIMENSIONS)
    for i in range(1, len(letters) - 1):
        if letters[i] != " ":
            a, b, c = (langid.letter_vector(ord(x)).astype(float) for x in letters[i - 1 : i + 2])
            total += a * np.roll(b, 1) * np.roll(c, 2)
    owner, inverse, three = langid.sequences([text.lower()])
    assert np.array_equal(langid.bundle(owner, 1, inverse, three)[0], total)


def test_language_of_odd_rows(make, monkeypatch):
    docs = make([(i, t, "en", None) for i, t in ODD] + [(9, "123 !?"), (10, "zz " * 50)], ("lang_pred", "held_out"))
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 6, 7)} == {"en"}
    assert langid.identify(empty(make)).count() == 0
    unlabelled = langid.identify(odd(make)).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    # Row 10 has no sequence in common with the texts that were learned.
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {1, 2, None, 6, 7}
    whole, one = langid.classify(["ab cd " * 99], ["en"], np.ones((1, langid.DIMENSIONS), np.float32) / 32)[1], None
    monkeypatch.setattr(langid, "PIECE_CHARS", 60)
    one = langid.classify(["ab cd " * 99], ["en"], np.ones((1, langid.DIMENSIONS), np.float32) / 32)[1]
    assert np.allclose(whole, one)


def test_languages_not_learned_are_rejected(spark, make):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    strange = [
        (20001, "Қазақстан Республикасы тәуелсіз мемлекет болып табылады және оның халқы көп"),
        (20002, "zzxq qzxj xqzz kkjq"),
        (20003, "zzxq qzxj xqzz kkjq " * 300),
        (20004, "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα " * 9),
        (20005, "日本語の文章です"),
    ]
    rows = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(make(strange))
    kept = {r.doc_id for r in langid.accepted(rows, rows=100).select("doc_id").collect()}
    lettered = {r.doc_id for r in documents.collect() if any(c.isalpha() for c in r.text or "")}
    assert not kept & {i for i, _ in strange} and kept <= lettered
    assert len(lettered - kept) <= 2


# SimHash ----------------------------------------------------------------------


def expect_simhash(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    root = brute.linked(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True))


def as_counter(found):
    shown = found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"), "component_id")
    return Counter(map(tuple, shown.collect()))


def test_simhash_matches_brute_force(spark, sf_dir, texts):
    found = Counter(map(tuple, queries.QUERIES["op3_simhash"](spark, sf_dir).collect()))
    assert found == expect_simhash([(i, t[0]) for i, t in texts.items()])


def test_simhash_on_odd_rows(make):
    assert as_counter(simhash.near_copies(odd(make))) == expect_simhash(ODD)
    assert simhash.near_copies(empty(make)).count() == 0


def test_simhash_of_long_text(monkeypatch):
    text = " ".join(f"w{i % 97} Q{i}" for i in range(3000))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 100)
    assert simhash.fingerprint_of(text) == brute.fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_clusters(spark, radius):
    draw = random.Random(radius)
    codes = set()
    for _ in range(40):
        seed = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 60])):
            code = seed
            for _ in range(draw.randrange(5)):
                code ^= 1 << draw.randrange(64)
            codes.add(code)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    table = spark.createDataFrame(signed, "code bigint").repartition(3)
    edges = simhash.links(table, radius, leaf=8, fan=3, top=4)
    found = {r.u: r.root for r in simhash.components(edges).collect()}
    classes = defaultdict(set)
    for (c,) in signed:
        classes[found.get(c, c)].add(c & (2**64 - 1))
    want = defaultdict(set)
    for code, root in brute.linked(codes, radius).items():
        want[root].add(code)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_gray_rank(spark):
    codes = [i ^ (i >> 1) for i in range(200)]
    table = spark.createDataFrame(list(enumerate(codes)), "place bigint, code bigint")
    ranks = table.select("place", (simhash.gray_rank(F.col("code")) - F.lit(-(2**63))).alias("rank")).collect()
    assert all(r.place == r["rank"] for r in ranks)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)]
    draw = random.Random(1)
    draw.shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.u: r.root for r in found} == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}


def test_near_verdict_keeps_one_of_each(make):
    docs = odd(make)
    kept = apply_verdict(docs, simhash.verdict_of(simhash.near_copies(docs)))
    assert kept.columns == docs.columns
    prints = [brute.fingerprint(t) for _, t in ODD]
    assert kept.count() == len(set(brute.linked(prints).values()))


# mixing -----------------------------------------------------------------------


def check_mix(rows, found):
    sizes = Counter()
    largest = Counter()
    for _, text, _, source in rows:
        n = len(brute.WORDS.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = brute.targets({s: sizes[s] for _, _, _, s in rows})
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
    by_id = {i: s for i, _, _, s in rows}
    for r in found:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        taken[source] += r.taken
    return want, taken, largest


def test_mix_of_documents(spark, sf_dir, texts):
    found = queries.QUERIES["op5_mixing"](spark, sf_dir).collect()
    rows = [(i, t, lang, source) for i, (t, lang, source) in texts.items()]
    want, taken, largest = check_mix(rows, found)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = queries.QUERIES["op5_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_mix_in_many_blocks(make):
    draw = random.Random(3)
    rows = [
        (i, "w " * int(draw.expovariate(1 / 60)), "en", draw.choice(["a", "a", "b", "c", "d", None])) for i in range(4000)
    ]
    found = mixing.mix(make(rows), block=100).collect()
    want, taken, _ = check_mix(rows, found)
    assert all(abs(taken[s] - want[s]) <= 60 for s in want), (want, taken)
    other = mixing.mix(make(rows[::-1]).repartition(7), block=100).collect()
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in other}


def test_mix_on_odd_rows(make):
    docs = odd(make)
    mixed = mixing.mix(docs)
    assert mixed.count() == len(ODD)
    assert mixing.mix(empty(make)).count() == 0
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in mixed.collect())


# BPE --------------------------------------------------------------------------

PATH = public_tokenizers.path(queries.TOKENIZER)


def expect_bpe(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(decoded))] += 1
    return want


def test_bpe_matches_library(spark, sf_dir, texts):
    found = Counter(map(tuple, queries.QUERIES["op9_bpe"](spark, sf_dir).collect()))
    assert found == expect_bpe([(i, t[0]) for i, t in texts.items()])


@pytest.mark.parametrize("block_words", [1, 13, 1 << 20])
def test_bpe_on_odd_texts(make, block_words):
    rows = [
        *ODD,
        (20, "a<|endoftext|>b <|endoftext|><|endoftext|> <|endof"),
        (21, "tab\tnew\n\n  spaces      it's 12³ ½ ͸ \U0001f600́ 日本語 \x00\x01\x85​"),
        (22, "x" * 5000 + " y" * 3000),
        (23, "<|endoftext|>"),
    ]
    found = bpe.encode_decode(make(rows, CLASHES), PATH, block_words)
    assert Counter(map(tuple, queries.digests(found).collect())) == expect_bpe(rows)
    texts = {r.doc_id: r.decoded for r in found.collect() if r.doc_id and r.doc_id >= 20}
    assert texts == {i: t for i, t in rows if i and i >= 20}


def test_bpe_of_nothing(make):
    assert bpe.encode_decode(empty(make), PATH).count() == 0
    assert bpe.encode_decode(make([(1, None), (2, "")]), PATH).count() == 2


# pipeline ---------------------------------------------------------------------


def test_pipeline_by_stages(spark, sf_dir, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        assert result.columns == documents.columns
        rows = result.collect()
        kept[name] = rows
        docs = spark.createDataFrame(rows, documents.schema)
    assert [r.doc_id for r in kept["language_id"] if not any(c.isalpha() for c in r.text or "")] == []
    lowered = defaultdict(list)
    for r in kept["language_id"]:
        lowered[r.text.translate(brute.LOWER)].append(r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(min(v) for v in lowered.values())
    texts = {r.doc_id: r.text for r in kept["exact_dedup"]}
    links = [(a, b) for a, b in combinations(texts, 2) if brute.likeness(texts[a], texts[b]) >= 0.8]
    assert any(texts[a].split() != texts[b].split() for a, b in links)
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(set(brute.roots(texts, links).values()))
    copies = Counter(r.doc_id for r in kept["mix_sources"])
    assert set(copies) <= {r.doc_id for r in kept["near_dedup"]} and max(copies.values()) <= 2
    mixed = mixing.mix(spark.createDataFrame(kept["near_dedup"], documents.schema)).collect()
    assert copies == Counter({r.doc_id: r.copies for r in mixed if r.copies})
    ran = Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert ran == expect_bpe([(r.doc_id, r.text) for r in kept["mix_sources"]])


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, make, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = odd(make)
    result = stage(spark, docs, sf_dir)
    assert number == 4 or result.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in result.collect()) if number < 4 else None
    if name == "exact_dedup":
        assert kept == Counter([(1, "Same Text here"), (3, None), (5, " \t\n "), (6, "Éa same"), (7, "éa same")])
    elif name == "near_dedup":
        # Words alike but for A-Z are one node; "Éa" and "éa" differ, as do texts without a word from others.
        assert kept == Counter([(1, "Same Text here"), (3, None), (6, "Éa same"), (7, "éa same")])
    elif name == "bpe":
        assert Counter(map(tuple, result.collect())) == expect_bpe(ODD)
    elif name == "mix_sources":
        mixed = mixing.mix(docs).collect()
        assert sum(kept.values()) == sum(r.copies for r in mixed) > 0
    else:
        # Nothing was learned without a language, so every text is undecided.
        assert not kept
    nothing = empty(make)
    result = stage(spark, nothing, sf_dir)
    assert result.count() == 0 and (number == 4 or result.columns == nothing.columns)
