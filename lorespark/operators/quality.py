"""Table audits: the constraint system as set-based checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.sources.corpus import reasons


def repeated_keys(
    df: DataFrame, keys: Sequence[str], ignore_case: bool = False, nulls_equal: bool = True
) -> DataFrame:
    """(keys…, copies) of key values that occur more than once.

    Null parts either compare equal or, as in a unique index, exempt the row.
    """
    rows = df if nulls_equal else df.dropna(subset=list(keys))
    types = dict(df.dtypes)
    parts = [
        (F.lower(k) if ignore_case and types[k] == "string" else F.col(k)).alias(k) for k in keys
    ]
    return rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def row_checks(df: DataFrame, key: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """(key…, problems) of rows that break a named rule; null results pass."""
    broken = reasons(*[(~F.coalesce(ok, F.lit(True)), name) for name, ok in checks.items()])
    return df.select(*key, broken.alias("problems")).filter(F.size("problems") > 0)


def outside_domain(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """(value, n) of values that are not in the domain table (value)."""
    used = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return used.join(allowed, "value", "left_anti")


def several_true(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """(key, n) of keys with more than one row whose flag is true."""
    return df.groupBy(key).agg(F.count_if(flag).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, on_delete: str) -> DataFrame:
    """(missing_key, rows, action): referenced keys without a parent.

    Child keys are counted first, so the anti join sees each key once.
    """
    action = {"cascade": "delete rows", "set null": "clear reference", "restrict": "report"}[on_delete]
    used = child.filter(F.col(child_key).isNotNull()).groupBy(
        F.col(child_key).alias("missing_key")
    ).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias("missing_key"))
    return used.join(known, "missing_key", "left_anti").withColumn("action", F.lit(action))


def cascade(levels: Sequence[tuple[str, DataFrame, str, str | None]], roots: DataFrame) -> DataFrame:
    """(table, id): every row removed with the given root ids.

    ``levels`` lists (name, table, id column, parent column) from the root
    down; ``roots`` holds the root ids. Parent ids of a level are unique, so
    each step is a semi join.
    """
    out, gone = None, None
    for name, table, key, parent in levels:
        keep = table.select(F.col(key).alias("id"), *([F.col(parent).alias("__p")] if parent else []))
        if parent is None:
            removed = keep.join(roots.select(F.col(roots.columns[0]).alias("id")), "id", "left_semi")
        else:
            removed = keep.join(gone.withColumnRenamed("id", "__p"), "__p", "left_semi").select("id")
        gone = removed.select(F.col("id").cast("bigint").alias("id"))
        part = gone.select(F.lit(name).alias("table"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_changes(
    before: DataFrame, after: DataFrame, key: str, frozen: Sequence[str], status: str,
    final: str = "succeeded", invalid: str = "invalidated",
) -> DataFrame:
    """(key, problem) for final rows that vanished or changed.

    A final row may only move its status to ``invalid``; the frozen columns
    compare by hash so that wide rows stay cheap to join.
    """
    digest = F.xxhash64(*[F.col(c) for c in frozen])
    old = before.filter(F.col(status) == final).select(key, F.col(status).alias("__s0"), digest.alias("__h0"))
    new = after.select(key, F.col(status).alias("__s1"), digest.alias("__h1"))
    joined = old.join(new, key, "left")
    problem = (
        F.when(F.col("__h1").isNull(), "row disappeared")
        .when(F.col("__h0") != F.col("__h1"), "frozen column changed")
        .when(~F.col("__s1").isin(final, invalid), "status changed")
    )
    return joined.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def append_only(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, problem) for history rows that changed or disappeared."""
    digest = F.xxhash64(*[F.col(c) for c in columns])
    old = before.select(key, digest.alias("__h0"))
    new = after.select(key, digest.alias("__h1"))
    problem = F.when(F.col("__h1").isNull(), "row disappeared").when(
        F.col("__h0") != F.col("__h1"), "row changed"
    )
    return old.join(new, key, "left").select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def scoped(df: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """Rows inside a principal's scope: None sees all, an empty scope nothing."""
    return df if scope is None else df.join(scope.select(key).distinct(), key, "left_semi")


def redacted(df: DataFrame, role: Column, reviewers: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Hide columns from roles below reviewer."""
    may_see = role.isin(list(reviewers))
    return df.withColumns({c: F.when(may_see, F.col(c)) for c in columns})
