"""Relational operators as functions of DataFrames; Catalyst picks their physical form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..functions.compat import ascending, descending
from ..session import cut


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Any of inner, left, right, full, left_semi, left_anti, on any condition."""
    return left.join(right, on, how)


CUT_STEPS = 16


def guarded_join(left: DataFrame, right: DataFrame, on: Column, most: int, how: str = "inner") -> DataFrame:
    """A join that is refused if the product of its inputs' counts exceeds `most`."""
    if left.count() * right.count() > most:
        raise ExecutionError(f"join of more than {most} pairs of rows")
    return left.join(right, on, how)


def in_subquery(df: DataFrame, value: Column, sub: DataFrame) -> DataFrame:
    """Rows whose value is in the only column of sub, nulls equal nulls."""
    return df.join(sub, value.eqNullSafe(sub[sub.columns[0]]), "left_semi")


def not_in_subquery(df: DataFrame, value: Column, sub: DataFrame, blind: bool = False) -> DataFrame:
    """ANSI NOT IN; `blind` ignores nulls in sub and keeps null values."""
    s = sub[sub.columns[0]]
    if blind:
        return df.join(sub, value == s, "left_anti")
    same = value == s
    return df.join(sub, same | same.isNull(), "left_anti")  # which Spark plans as a null-aware anti join


def aggregate(df: DataFrame, by: Sequence, *columns: Column, having: Column | None = None) -> DataFrame:
    out = df.groupBy(*by).agg(*columns)
    return out if having is None else out.filter(having)


def window(partition: Sequence = (), order: Sequence[tuple[str, bool]] = ()) -> Window:
    """A window in the dialect's null order; (column, descending) pairs."""
    keys = [descending(F.col(c)) if down else ascending(F.col(c)) for c, down in order]
    w = Window.partitionBy(*partition)
    return w.orderBy(*keys) if keys else w


def sort(df: DataFrame, *order: tuple) -> DataFrame:
    """Sorted by (column or name, descending) pairs; nulls are the largest."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.orderBy(*[descending(as_col(c)) if down else ascending(as_col(c)) for c, down in order])


def top(df: DataFrame, order: Sequence[tuple], limit: int, offset: int = 0) -> DataFrame:
    out = sort(df, *order)
    return (out.offset(offset) if offset else out).limit(limit)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("__n", F.row_number().over(window(keys, order))).filter("__n = 1").drop("__n")


def union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.union(b) if all else a.union(b).distinct()


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(b) if all else a.subtract(b)


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.intersectAll(b) if all else a.intersect(b)


def recursive(spark: SparkSession, anchor: DataFrame, step, most: int = 100, distinct: bool = True) -> DataFrame:
    """WITH RECURSIVE by iteration over the last delta, where Spark's own form (UNION ALL only) doesn't fit.

    `step` makes a DataFrame from the delta. Ends when the delta is empty, and raises after `most` steps. Only deltas are written, and what they add up to every CUT_STEPS steps.
    """
    delta = cut(anchor.distinct() if distinct else anchor)
    out = delta
    for at in range(1, most + 1):
        new = step(delta).toDF(*anchor.columns)
        new = new.distinct().join(out, [new[c].eqNullSafe(out[c]) for c in anchor.columns], "left_anti") if distinct else new
        delta = cut(new)
        if delta.isEmpty():
            return out
        out = out.union(delta)
        out = out if at % CUT_STEPS else cut(out)
    raise ExecutionError(f"recursion deeper than {most}")
