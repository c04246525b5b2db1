"""Work per row stays bounded: lines are decoded once, tasks grow in number, plain paths need no scan."""

from __future__ import annotations

import ast
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lapstream import session
from lapstream.operators import tree
from lapstream.plans import queries_sources as sources
from lapstream.sources import recordings

KINDS = ("click", "purchase", "view", "error", "signup")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """300 events of every kind and k, quoted, junk and empty lines among them."""
    at = dt.datetime(2031, 3, 1)
    rows = [
        (i, at + dt.timedelta(hours=i), i % 23, KINDS[i % 5], i * 0.5, json.dumps({"k": i % 100})) for i in range(300)
    ]
    folder = tmp_path_factory.mktemp("odd")
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_lines_are_decoded_once(spark, odd_dir):
    found = sources.decode_lines(spark, odd_dir)
    assert found._jdf.queryExecution().toString().count("ArrowEvalPython [_read_lines") == 0
    rows = found.collect()
    assert len(rows) == len({r["seq"] for r in rows}) == 297
    by_seq = {r["seq"]: r for r in rows}
    assert by_seq[3]["fields"] == 'Status="3"' and by_seq[3]["micros"] is not None
    assert by_seq[1]["micros"] is None and 'Lines/1/LastLapTime/Value=""' in by_seq[1]["fields"]


LITERALS = (
    """['T', {'a': [True, None, -1.5], "b": "it's"}, '2031Z']""",
    """["T", {"a": "x"}]""",
    "['T', 'text', '']",
)
ODD = (
    r"""['T', {'a': 'it\'s'}]""", """['T', {'a': 'say "x"'}]""", "['T', {1: (2, 'b')}]", "['T' 'U', 1e400]", "['T', true]",
    '["T", true]', '["T", NaN]', "['T', [0x10, 1_0]]", "['T', b'x']", "['''T''', 1]", "{'T': 1}", "['T']", "not [ a line", "",
    "['T', " + "[" * 90 + "]" * 90 + "]", "['T', '\t']", "[3, False]",
)


@pytest.mark.parametrize("line", LITERALS + ODD)
def test_lines_read_as_compiled(monkeypatch, line):
    quick = recordings.read_line(line)

    def slow(_):
        raise ValueError("left to the compiler")

    monkeypatch.setattr(recordings, "_plain_literal", slow)
    assert recordings.read_line(line) == quick


@pytest.mark.parametrize("line", LITERALS)
def test_plain_literals_are_not_compiled(monkeypatch, line):
    want = recordings.read_line(line)
    monkeypatch.setattr(ast, "literal_eval", lambda _: pytest.fail("compiled"))
    assert recordings.read_line(line) == want is not None


def test_tasks_grow_with_rows(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20, raising=False)
    events = spark.read.parquet(f"{odd_dir}/events.parquet")
    dealt = session.spread(events)
    assert dealt.rdd.getNumPartitions() == 15
    assert sorted(dealt.collect()) == sorted(events.collect())
    assert session.spread(dealt).rdd.getNumPartitions() == 15


def told(spark, messages, name="s"):
    rows = [(name, "T", i, json.dumps(m)) for i, m in enumerate(messages)]
    events = spark.createDataFrame(rows, "session_id string, topic string, seq long, j string")
    return events.withColumn("payload", F.parse_json("j"))


def folded(events):
    return {"/".join(r["path"]): r["value"] for r in tree.fold_tree(events).collect()}


@pytest.fixture
def scanned(monkeypatch):
    """Rows handed to every ordered scan."""
    seen = []
    running = tree.running

    def counted(df, *args, **named):
        seen.append(df.count())
        return running(df, *args, **named)

    monkeypatch.setattr(tree, "running", counted)
    return seen


def test_plain_paths_are_not_scanned(spark, scanned):
    messages = [{"Lines": {"5": {"Position": str(i), "Gap": i}}} for i in range(9)]
    assert folded(told(spark, messages)) == {"Lines/5/Position": '"8"', "Lines/5/Gap": "8"}
    assert scanned == []


@pytest.mark.parametrize("name", ["s", None])
def test_only_mixed_paths_are_scanned(spark, scanned, name):
    messages = [{"a": i, "s": [1, 2]} for i in range(5)] + [{"s": {"1": 9}}, {"e": {}}]
    assert folded(told(spark, messages, name)) == {"a": "4", "s/0": "1", "s/1": "9", "e": "{}"}
    assert scanned[0] == 7


def test_payloads_are_opened_where_they_were_dealt(spark):
    """A filter on the payload would move below the shuffle, into the few splits of the scan."""
    dealt = told(spark, [{"a": 1}, {"b": 2}]).repartition(5, "seq")
    plan = tree._writes(dealt)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
