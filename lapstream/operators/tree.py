"""The merged raw tree of every topic, kept as a table of leaves.

A message changes parts of a tree: objects merge key by key, an object keyed by
digits patches the elements of a list, anything else replaces what was there and
all below it. A payload is opened once, into a row for every path it touches. On most
paths every write is a scalar, or every write is an object that holds something: there
the last write stands, and nothing is lost with it, as a path of scalars has nothing
below. One aggregate finds these last writes, and the paths that are mixed: lists,
empty containers, or scalars beside containers. Only the writes of mixed paths are
scanned in order: two scans say what each write left there and which writes replaced
what was there before.

Whether a write replaces follows from the write before it on the same path, even
if an ancestor was replaced in between: such a path has nothing below it that could
be lost twice. Only two kinds of write must know of the last replacement above
them: a digit-keyed object whose path last held a list, and an empty container that
would merge. They alone look it up, by a running maximum over the replacements of
their ancestors; where the answer turns out to matter the scan is repeated, at most
once per level of the tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapstream.operators.scan import CHUNK_SPAN, running
from lapstream.session import cut_lineage

KEYS = ("session_id", "topic", "path")
OBJECT, INDEXED, LIST, SCALAR = "object", "indexed", "list", "scalar"


class _Number(str):
    """A number as it is written."""


_load = json.JSONDecoder(parse_int=_Number, parse_float=_Number).decode
_spelled = json.JSONEncoder(ensure_ascii=False).encode


def opened(body: str) -> list[tuple[list[str], str, bool, str | None]]:
    """Every path a payload touches, with its kind, whether it is empty, and its JSON where it is a
    leaf. Depth is bounded by the payload, not by the stack."""
    found, todo = [], [([], _load(body))]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            kind = INDEXED if value and all(k.isascii() and k.isdigit() for k in value) else OBJECT
            found.append((path, kind, not value, None if value else "{}"))
            todo += [([*path, k], v) for k, v in value.items()]
        elif isinstance(value, list):
            found.append((path, LIST, not value, None if value else "[]"))
            todo += [([*path, str(i)], v) for i, v in enumerate(value)]
        else:
            text = str(value) if isinstance(value, _Number) else _spelled(value)
            found.append((path, SCALAR, False, text))
    return found


def _texts(rows: list[list[str]]) -> pa.ListArray:
    """A column of lists of texts, built flat."""
    ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(rows), pa.string()))


def _places(sizes: Iterator[int]) -> pa.Array:
    return pa.array(accumulate(sizes, initial=0), pa.int32())


def _texts(rows: list[list[str]]) -> pa.ListArray:
    """A column of lists of texts, built flat."""
    return pa.ListArray.from_arrays(_places(map(len, rows)), pa.array(chain.from_iterable(rows), pa.string()))


def _containers(bodies: pa.Array) -> Iterator[tuple[int, list]]:
    """Place and paths of every payload that is an object or a list."""
    for place, body in enumerate(bodies.to_pylist()):
        touched = [] if body is None else opened(body)
        if touched and touched[0][1] != SCALAR:
            yield place, touched


def _bodies(events: DataFrame) -> tuple[DataFrame, str]:
    """Payloads as JSON, NULL where there is none, and the schema of what names them. They are not
    filtered here: a filter would move below a shuffle that deals the payloads out."""
    kind = dict(events.dtypes)["session_id"]
    body = F.to_json("payload").alias("body")
    rows = events.select("session_id", "topic", F.col("seq").cast("bigint").alias("seq"), body)
    return rows, f"session_id {kind}, topic string, seq bigint"


def _writes(events: DataFrame) -> DataFrame:
    """session_id, topic, seq, path, kind, empty and value of every path of every message."""
    bodies, named = _bodies(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, where = [], []
            for place, touched in _containers(batch.column("body")):
                rows += touched
                where += [place] * len(touched)
            at = pa.array(where, pa.int64())
            paths, kinds, empty, values = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("session_id", "topic", "seq")),
                    _texts(paths),
                    pa.array(kinds, pa.string()),
                    pa.array(empty, pa.bool_()),
                    pa.array(values, pa.string()),
                ],
                ["session_id", "topic", "seq", "path", "kind", "empty", "value"],
            )

    return bodies.mapInArrow(run, f"{named}, path array<string>, kind string, empty boolean, value string")


def _canonical(value: Column) -> Column:
    """JSON as Spark spells it. Texts without escapes are spelled that way already."""
    same = F.startswith(value, F.lit('"')) & ~F.contains(value, F.lit("\\"))
    return F.when(same, value).otherwise(F.to_json(F.parse_json(value)))


def leaves_by_payload(events: DataFrame) -> DataFrame:
    """A row for every payload that is an object or a list: session_id, topic, seq and its leaves,
    an array of path, kind and value (JSON)."""
    bodies, named = _bodies(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, where, sizes = [], [], []
            for place, touched in _containers(batch.column("body")):
                leaves = [t for t in touched if t[3] is not None]
                rows += leaves
                where.append(place)
                sizes.append(len(leaves))
            at = pa.array(where, pa.int64())
            paths, kinds, _, values = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            parts = [_texts(paths), pa.array(kinds, pa.string()), pa.array(values, pa.string())]
            inside = pa.StructArray.from_arrays(parts, ["path", "kind", "value"])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("session_id", "topic", "seq")),
                    pa.ListArray.from_arrays(_places(sizes), inside),
                ],
                ["session_id", "topic", "seq", "leaves"],
            )

    found = bodies.mapInArrow(run, f"{named}, leaves array<struct<path: array<string>, kind: string, value: string>>")
    spelled = F.transform(
        "leaves",
        lambda x: F.struct(x.path.alias("path"), x.kind.alias("kind"), _canonical(x.value).alias("value")),
    )
    return found.withColumn("leaves", spelled)


def payload_leaves(events: DataFrame) -> DataFrame:
    """Leaves of every single payload: session_id, topic, seq, path, kind and value (JSON)."""
    leaves = leaves_by_payload(events).select("session_id", "topic", "seq", F.inline("leaves"))
    return leaves.select(*KEYS, "seq", "kind", "value")


def _judged(seen: DataFrame, span: int) -> DataFrame:
    """What each write left on its path (shape), and what it did to what was there."""
    patches = (F.col("kind") == INDEXED) & (F.col("fixed.kind") == LIST) & (F.col("fixed.seq") >= F.col("epoch"))
    left = F.when(F.coalesce(patches, F.lit(False)), LIST).when(F.col("kind") == INDEXED, OBJECT)
    shaped = seen.withColumn("shape", F.coalesce(left, F.col("kind")))
    before = running(
        cut_lineage(shaped, "tree-shapes"), KEYS, "seq", lags={"was": F.col("shape"), "was_seq": F.col("seq")}, span=span
    )
    merges = ((F.col("was") == OBJECT) & F.col("kind").isin(OBJECT, INDEXED)) | (
        (F.col("was") == LIST) & (F.col("kind") == INDEXED)
    )
    alive = F.coalesce(F.col("was_seq") >= F.col("epoch"), F.lit(False))
    replaced = F.col("was").isNotNull() & ~merges
    judged = before.withColumns({"replaced": replaced, "idle": alive & merges & F.col("empty")})
    return cut_lineage(judged, "tree-judged")


def _ancestors(path: str = "path"):
    depths = F.sequence(F.lit(0), F.size(path) - 1)
    return F.when(F.size(path) > 0, F.transform(depths, lambda n: F.slice(path, F.lit(1), n)))


def _epochs(judged: DataFrame, span: int) -> DataFrame:
    """Last replacement above each write that must know it, up to its own message."""
    asks = ((F.col("kind") == INDEXED) & (F.col("fixed.kind") == LIST)) | (F.col("empty") & F.col("was").isNotNull())
    asked = judged.where(asks).select(*KEYS, "seq", F.explode(_ancestors()).alias("above"))
    marks = judged.where("replaced").select(
        "session_id", "topic", F.col("path").alias("above"), "seq", F.col("seq").alias("reset")
    )
    # A replacement comes before the questions of the same message.
    both = asked.select("session_id", "topic", "above", (F.col("seq") * 2 + 1).alias("tick"), F.lit(None).cast("bigint").alias("reset"))
    both = both.distinct().unionByName(
        marks.select("session_id", "topic", "above", (F.col("seq") * 2).alias("tick"), "reset")
    )
    both = cut_lineage(both, "tree-marks")
    known = running(both, ("session_id", "topic", "above"), "tick", maxima={"last": F.col("reset")}, span=2 * span)
    answers = known.where("reset is null").select("session_id", "topic", "above", F.expr("tick div 2").alias("seq"), "last")
    return asked.join(answers, ["session_id", "topic", "above", "seq"]).groupBy(*KEYS, "seq").agg(F.max("last").alias("known"))


def fold_tree(events: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Leaves of the merged tree: session_id, topic, path, kind, value, in_list, seq.

    A leaf is a scalar or an empty container; ``value`` is its JSON. Payloads that
    are neither object nor list are ignored.
    """
    writes = cut_lineage(_writes(events), "tree-writes")
    last = _last(writes)
    plain = last.where("not mixed").drop("mixed")
    mixed = last.where("mixed").select(F.struct(*KEYS).alias("_at"))
    if mixed.isEmpty():
        return _shown(plain.withColumn("in_list", F.lit(False)))
    # NULL fields of structs are equal, those of columns are not.
    writes = writes.withColumn("_at", F.struct(*KEYS)).join(mixed, "_at", "left_semi").drop("_at")
    writes = cut_lineage(writes, "tree-mixed")
    # An indexed object over a list leaves a list; otherwise writes speak for themselves.
    fixed = F.when(F.col("kind") != INDEXED, F.struct("seq", "kind"))
    seen = running(writes, KEYS, "seq", lasts={"fixed": fixed}, span=span)
    judged = _judged(seen.withColumn("epoch", F.lit(-1).cast("bigint")), span)
    while True:
        known = cut_lineage(_epochs(judged, span).where("known is not null"), "tree-epochs")
        asked = judged.join(known, [*KEYS, "seq"])
        # It matters where the list or the container before is older than the replacement above.
        matters = (F.col("known") > F.col("epoch")) & (
            ((F.col("kind") == INDEXED) & (F.col("fixed.seq") < F.col("known")) & (F.col("fixed.seq") >= F.col("epoch")))
            | (F.col("idle") & (F.col("was_seq") < F.col("known")))
        )
        if asked.where(matters).isEmpty():
            return _alive(judged, plain)
        again = judged.select(*seen.columns).join(known, [*KEYS, "seq"], "left")
        judged = _judged(again.withColumn("epoch", F.coalesce("known", F.lit(-1).cast("bigint"))).drop("known"), span)


def _last(writes: DataFrame) -> DataFrame:
    """Last write of every path that is mixed or holds scalars: session_id, topic, path, seq, kind, value, mixed."""
    scalar = F.col("kind") == SCALAR
    mixed = F.bool_or((F.col("kind") == LIST) | F.col("empty")) | (F.bool_or(scalar) & F.bool_or(~scalar))
    entry = F.when(F.col("seq").isNotNull(), F.struct("seq", "kind", "value"))
    last = writes.groupBy(*KEYS).agg(F.max(entry).alias("e"), mixed.alias("mixed"))
    kept = last.where(F.col("mixed") | (F.col("e.kind") == SCALAR))
    return cut_lineage(kept.select(*KEYS, "e.seq", "e.kind", "e.value", "mixed"), "tree-last")


def _alive(writes: DataFrame, plain: DataFrame) -> DataFrame:
    """Last write per path, where it is a leaf no ancestor was replaced after: of mixed paths
    from all their writes, of the others as found."""
    entry = F.struct("kind", "empty", "value")
    last = writes.where(~F.col("idle")).groupBy(*KEYS).agg(
        F.max_by(entry, "seq").alias("e"), F.max("seq").alias("seq")
    )
    leaves = last.where((F.col("e.kind") == SCALAR) | F.col("e.empty")).select(*KEYS, "seq", "e.kind", "e.value")
    leaves = leaves.unionByName(plain)
    # Both are small where little is replaced; once written, their size says so to the joins.
    resets = cut_lineage(
        writes.where("replaced")
        .groupBy("session_id", "topic", F.col("path").alias("above"))
        .agg(F.max("seq").alias("reset_seq")),
        "tree-resets",
    )
    lost = (
        leaves.withColumn("above", F.explode(_ancestors()))
        .join(resets, ["session_id", "topic", "above"])
        .where(F.col("reset_seq") > F.col("seq"))
        .select(*KEYS)
        .distinct()
    )
    # What the container above was, after the same message.
    above = writes.where(F.col("shape") == LIST).select(
        "session_id", "topic", F.col("path").alias("above"), "seq", F.lit(True).alias("list_above")
    )
    kept = leaves.join(cut_lineage(lost, "tree-lost"), list(KEYS), "left_anti").withColumn(
        "above", F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    )
    listed = kept.join(above, ["session_id", "topic", "above", "seq"], "left")
    return _shown(listed.withColumn("in_list", F.coalesce("list_above", F.lit(False))))


def _shown(leaves: DataFrame) -> DataFrame:
    return leaves.select(*KEYS, "seq", "kind", _canonical(F.col("value")).alias("value"), "in_list")


def list_arrays(leaves: DataFrame) -> DataFrame:
    """Lists of scalars as arrays of JSON, NULL where an element was never sent."""
    inside = leaves.where("in_list").withColumns(
        {
            "list_path": F.slice("path", F.lit(1), F.size("path") - 1),
            "place": F.element_at("path", F.lit(-1)).cast("bigint"),
        }
    )
    gathered = inside.groupBy("session_id", "topic", "list_path").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("known"),
        F.max("place").alias("top"),
    )
    filled = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("top")),
        lambda i: F.try_element_at("known", i),
    )
    return gathered.select("session_id", "topic", "list_path", filled.alias("elements"))
