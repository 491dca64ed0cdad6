"""Column functions for the semantics in which the dialect differs from ANSI SQL; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def float_div(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN for zero divisors."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull(), None).when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def eq2v(a: Column, b: Column) -> Column:
    """Two-valued equality: false where either side is null."""
    return F.coalesce(a == b, F.lit(False))


def not_like2v(a: Column, pattern: str) -> Column:
    """NOT LIKE that holds for null."""
    return ~F.coalesce(a.like(pattern), F.lit(False))


def close(a: Column, b: Column) -> Column:
    """Equality of doubles within machine epsilon."""
    return F.abs(a - b) < F.lit(EPSILON)


def truthy(a: Column, kind: str) -> Column:
    """Nonzero numbers, nonempty texts and nonempty arrays hold."""
    if kind == "boolean":
        return F.coalesce(a, F.lit(False))
    if kind == "string":
        return F.coalesce(F.length(a) > 0, F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(a) > 0, F.lit(False))
    return F.coalesce(a != 0, F.lit(False))


def sum0(a: Column) -> Column:
    """SUM that is 0 over nothing."""
    return F.coalesce(F.sum(a), F.lit(0))


def length_bytes(a: Column) -> Column:
    return F.octet_length(a).cast("bigint")


def json_get(a: Column, *path) -> Column:
    """`->` and `->>`: keys and indices in turn; null where there is none."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(a, "$" + steps)


def ascending(a: Column) -> Column:
    """Nulls sort as the largest value."""
    return a.asc_nulls_last()


def descending(a: Column) -> Column:
    return a.desc_nulls_first()
