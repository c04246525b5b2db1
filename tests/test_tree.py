"""Merged trees against a plain recursive merge, message by message."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lapstream.operators import tree


def merged(old, new):
    """What a message leaves of the tree it meets."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: merged(old[k], v) if k in old else v for k, v in new.items()}}
    if isinstance(old, list) and isinstance(new, dict) and new and all(k.isdigit() for k in new):
        out = list(old)
        for k, v in new.items():
            i = int(k)
            out += [None] * (i + 1 - len(out))
            out[i] = merged(out[i], v)
        return out
    return new


def leaves(node, path=(), in_list=False):
    if isinstance(node, dict) and node:
        return {p: v for k, x in node.items() for p, v in leaves(x, (*path, k)).items()}
    if isinstance(node, list) and node:
        return {p: v for i, x in enumerate(node) for p, v in leaves(x, (*path, str(i)), True).items()}
    return {path: node}


def folded(spark, messages, span=tree.CHUNK_SPAN):
    rows = [("s", "T", i, json.dumps(m)) for i, m in enumerate(messages)]
    events = spark.createDataFrame(rows, "session_id string, topic string, seq long, j string")
    events = events.withColumn("payload", F.parse_json("j"))
    found = tree.fold_tree(events, span).collect()
    return {tuple(r["path"]): json.loads(r["value"]) for r in found}


def expected(messages):
    state = None
    for m in messages:
        if isinstance(m, dict | list):
            state = merged(state, m)
    # Elements a list was padded with are not rows of the leaf table.
    return {p: v for p, v in leaves(state).items() if v is not None}


CASES = {
    "siblings are kept": [{"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}],
    "list patched": [{"s": [{"v": 1}, {"v": 2}]}, {"s": {"1": {"v": 9}}}],
    "list appended": [{"s": [1, 2]}, {"s": {"2": 3}}],
    "list padded": [{"s": [1]}, {"s": {"3": 4}}],
    "false and zero overwrite": [{"a": True, "b": 5}, {"a": False, "b": 0}],
    "empty object replaces a list": [{"s": [1, 2]}, {"s": {}}],
    "empty object leaves an object": [{"s": {"a": 1}}, {"s": {}}],
    "list replaces a list": [{"s": [1, 2, 3]}, {"s": [7]}],
    "scalar replaces an object": [{"s": {"a": {"b": 1}}}, {"s": 4}],
    "object replaces a scalar": [{"s": 4}, {"s": {"a": 1}}],
    "patch after the list is gone": [{"s": [1, 2]}, {"s": "x"}, {"s": {"0": 5}}, {"s": {"a": 6}}],
    "named keys replace a list": [{"s": [1, 2]}, {"s": {"a": 1}}],
    "parent replaced, child written again": [{"p": {"q": {"a": 1, "b": 2}}}, {"p": 0}, {"p": {"q": {"a": 3}}}],
    "list under a replaced parent": [{"p": {"s": [1, 2]}}, {"p": 1}, {"p": {"s": {"0": 9}}}, {"p": {"s": {"k": 1}}}],
    "text payload is ignored": [{"a": 1}, "junk", 5, {"b": 2}],
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    assert folded(spark, CASES[name]) == expected(CASES[name])


def tangle(depth=0):
    """A random payload that often changes the type of what is already there."""
    roll = random.random()
    if depth == 3 or roll < 0.25:
        return random.choice([0, 1, False, "t", 2.5])
    if roll < 0.45:
        return [tangle(depth + 1) for _ in range(random.randint(0, 3))]
    keys = "012" if roll < 0.75 else "ab0"
    return {k: tangle(depth + 1) for k in random.sample(keys, random.randint(0, 2))}


@pytest.mark.parametrize("span", [tree.CHUNK_SPAN, 4])
def test_random_messages(spark, span):
    random.seed(5 if span == 4 else 8)
    for _ in range(3):
        messages = [tangle() for _ in range(14)]
        messages = [m if isinstance(m, dict | list) else {"a": m} for m in messages]
        want = expected(messages)
        assert folded(spark, messages, span) == want


def test_lists_are_rebuilt_with_gaps(spark):
    rows = [("s", "T", 0, '{"s":[1]}'), ("s", "T", 1, '{"s":{"3":4}}')]
    events = spark.createDataFrame(rows, "session_id string, topic string, seq long, j string")
    found = tree.fold_tree(events.withColumn("payload", F.parse_json("j")))
    assert tree.list_arrays(found).first()["elements"] == ["1", None, None, "4"]
