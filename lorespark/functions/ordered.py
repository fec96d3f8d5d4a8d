"""Order-dependent columns for keys of any size.

A window over one key runs in one task, so a key that holds a third of the
rows would stall a job. These helpers split every key into segments (for
instance hours of its timeline), run the window inside a segment, and carry
the edge between segments through a small per-segment summary that is
aggregated map-side first. Segments must be monotone in the order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_SEG, _EDGE = "__segment", "__edge"


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_neighbour(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, str],
    forward: bool = False,
) -> DataFrame:
    """Add, per row, columns of the previous (or next) row of the same key.

    ``values`` maps new column names to existing columns.
    """
    keys = _names(keys)
    rows = df.withColumn(_SEG, segment)
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_SEG)
    payload = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    rank = F.struct(*[F.col(c) for c in order])
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    edges = (
        rows.groupBy(*keys, _SEG)
        .agg(pick(payload, rank).alias(_EDGE))
        .withColumn(_EDGE, step(_EDGE).over(across))
    )
    near = rows.withColumn("__near", step(payload).over(inside))
    joined = near.join(edges, [*keys, _SEG])
    best = F.coalesce("__near", _EDGE)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[best[name].alias(name) for name in values],
    )


def with_running(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    segment: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key (``F.lit(1)`` gives a row number)."""
    keys = _names(keys)
    rows = df.withColumn(_SEG, segment)
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = rows.groupBy(*keys, _SEG).agg(
        *[F.sum(expr).alias(f"__t_{name}") for name, expr in sums.items()]
    )
    bases = bases.select(
        *keys,
        _SEG,
        *[
            F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__b_{name}")
            for name in sums
        ],
    )
    part = rows.select(
        "*", *[F.sum(expr).over(inside).alias(f"__s_{name}") for name, expr in sums.items()]
    )
    joined = part.join(bases, [*keys, _SEG])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__b_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums],
    )


def first_arrivals(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """One row per key: the earliest ``carry`` columns and the group size.

    A plain aggregate, so hot keys shrink map-side before the shuffle.
    """
    keys = _names(keys)
    head = F.min_by(F.struct(*carry), F.struct(*order))
    grouped = df.groupBy(*keys).agg(head.alias("__h"), F.count(F.lit(1)).alias("arrivals"))
    return grouped.select(*keys, *[F.col(f"__h.{c}").alias(c) for c in carry], "arrivals")
