"""Ordered running values over keys of any size.

A plain window over (session, car) puts a whole key into one task. Here every key is cut
into chunks along the order column. Each chunk is windowed by itself, one small summary
row per chunk is folded along the key, and the value from the chunks before is joined
back. The answer is that of a plain window; the largest unit of work is one chunk. There
is one way for all sizes: a key that fits in one chunk has nothing to carry.

Rows are shuffled once, by (key, chunk): the chunk window and the join back share that
partitioning. The summary is a map-side combined aggregate. Keys and order may be NULL:
(key, chunk) is a struct, and structs with equal or NULL fields are equal. NULL orders
come first, as in a window.

A scan reads its input twice. Write a costly input out before it is scanned
(:func:`~lapstream.session.cut_lineage`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SPAN = 1 << 20
NO_ORDER = -(1 << 62)


def with_chunk(df: DataFrame, order: str, span: int = CHUNK_SPAN, name: str = "chunk") -> DataFrame:
    """Add the chunk number of each row: equal stretches of the order column."""
    if not span:
        raise ValueError("a scan needs a span to cut keys by")
    return df.withColumn(name, F.floor(F.col(order) / span))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    number: str | None = None,
    size: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    span: int = CHUNK_SPAN,
    chunk: str | None = None,
) -> DataFrame:
    """Add running values per key along ``order`` (unique within a key).

    number  row number            sums    sum up to and including this row
    size    rows in the key       maxima  maximum up to and including this row
    lasts   last non-NULL value so far      lags    value on the row before

    ``chunk`` names a column from :func:`with_chunk`; it is kept, so a further
    pass over the same keys finds its rows already in place.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    lasts, lags = dict(lasts or {}), dict(lags or {})
    named = {**sums, **maxima, **lasts, **lags}
    inputs = {name: f"_in_{name}" for name in named}
    chunked = df if chunk else with_chunk(df, order, span, "_chunk")
    chunk = chunk or "_chunk"
    chunked = chunked.withColumns({inputs[n]: c for n, c in named.items()}) if named else chunked
    chunked = chunked.withColumn("_by", F.struct(*keys, chunk))

    totals = [F.count(F.lit(1)).alias("_rows")]
    totals += [F.sum(inputs[n]).alias(f"_t_{n}") for n in sums]
    totals += [F.max(inputs[n]).alias(f"_t_{n}") for n in maxima]
    place = F.coalesce(F.col(order), F.lit(NO_ORDER))
    totals += [
        F.max_by(inputs[n], F.when(F.col(inputs[n]).isNotNull(), place)).alias(f"_t_{n}") for n in lasts
    ]
    totals += [F.max_by(inputs[n], place).alias(f"_t_{n}") for n in lags]
    of_key = [F.col(f"_by.{k}") for k in keys]
    before = Window.partitionBy(*of_key).orderBy(F.col(f"_by.{chunk}"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*of_key)
    carried = {f"_c_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums}
    carried |= {f"_c_{n}": F.max(f"_t_{n}").over(earlier) for n in maxima}
    carried |= {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(earlier) for n in lasts}
    carried |= {f"_c_{n}": F.lag(f"_t_{n}").over(before) for n in lags}
    if number:
        carried["_c_rows"] = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    if size:
        carried["_c_size"] = F.sum("_rows").over(whole)
    carry = chunked.groupBy("_by").agg(*totals).select(
        "_by", *[c.alias(n) for n, c in carried.items()]
    )

    along = Window.partitionBy("_by").orderBy(order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_l_{n}": F.sum(inputs[n]).over(upto) for n in sums}
    local |= {f"_l_{n}": F.max(inputs[n]).over(upto) for n in maxima}
    local |= {f"_l_{n}": F.last(inputs[n], ignorenulls=True).over(upto) for n in lasts}
    local |= {f"_l_{n}": F.lag(inputs[n]).over(along) for n in lags}
    if number or lags:
        local["_l_number"] = F.row_number().over(along)
    inside = chunked.withColumns(local) if local else chunked

    out = {}
    for n in sums:
        parts = [F.col(f"_c_{n}"), F.col(f"_l_{n}")]
        out[n] = F.when(
            parts[0].isNotNull() | parts[1].isNotNull(),
            F.coalesce(parts[0], F.lit(0)) + F.coalesce(parts[1], F.lit(0)),
        )
    out |= {n: F.greatest(f"_c_{n}", f"_l_{n}") for n in maxima}
    out |= {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}
    out |= {
        n: F.when(F.col("_l_number") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}"))
        for n in lags
    }
    if number:
        out[number] = F.col("_c_rows") + F.col("_l_number")
    if size:
        out[size] = F.col("_c_size")
    kept = [F.col(c) for c in df.columns if c not in out]
    return inside.join(carry, "_by").select(*kept, *[c.alias(n) for n, c in out.items()])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    name: str,
) -> DataFrame:
    """Row number within a key, for keys too big for one task.

    ``chunk`` must never decrease along ``order``: rows of a lower chunk come
    first. A rank is then the rows of lower chunks plus the place within its own.
    """
    chunked = df.withColumn("_by", F.struct(*keys, chunk.alias("_chunk")))
    earlier = (
        Window.partitionBy(*[F.col(f"_by.{k}") for k in keys])
        .orderBy("_by._chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        chunked.groupBy("_by")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_by", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"))
    )
    place = F.row_number().over(Window.partitionBy("_by").orderBy(*order))
    return (
        chunked.withColumn("_place", place)
        .join(carry, "_by")
        .withColumn(name, F.col("_ahead") + F.col("_place"))
        .select(*df.columns, name)
    )


def last_states(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    first: str | None = None,
) -> DataFrame:
    """Latest non-NULL value of each column per key, as one combined aggregate.

    ``first`` names a column for the lowest order value of the key.
    """
    latest = [
        F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name)
        for name, value in values.items()
    ]
    start = [F.min(order).alias(first)] if first else []
    return df.groupBy(*keys).agg(*latest, *start)
