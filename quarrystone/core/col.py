"""Columns from names and numbers, and IEEE arithmetic: Spark gives null or an error where doubles give inf or NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def to_col(x) -> Column:
    """A string names a column, a Column is itself, anything else is a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def dbl(x) -> Column:
    return to_col(x).cast("double")


def ieee_div(a, b) -> Column:
    """a / b as doubles: x/0 is inf, -inf or NaN (as x times 0 to the power -1 is)."""
    a, b = dbl(a), dbl(b)
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def ieee_ln(x) -> Column:
    x = dbl(x)
    return F.when(x.isNull(), F.lit(None)).when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(F.log(x))


def ieee_sqrt(x) -> Column:
    """NaN below zero, as Spark's own."""
    return F.sqrt(dbl(x))


def finite(x) -> Column:
    """x if it is a finite number, else null.  Short, as moments repeat it: a longer test made kurtosis too large to compile."""
    x = dbl(x)
    return F.when(x - x == 0, x)


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def over(by=None, order=None):
    """A window over groups; with ``order``, sorted."""
    by = [by] if isinstance(by, str | Column) else list(by or [])
    w = Window.partitionBy(*(to_col(b) for b in by)) if by else Window.partitionBy(F.lit(1))
    order = [order] if isinstance(order, str | Column) else list(order or [])
    return w.orderBy(*(to_col(o) for o in order)) if order else w


def quantile(x, q: float, method: str = "linear") -> Column:
    """The quantile of a column as an aggregate: linear, lower, higher, nearest or midpoint between the two values around it.

    Exact.  ``linear`` keeps counts of distinct values only; the others read the two order statistics from it.
    """
    x = finite(x)
    if method == "linear":
        return F.percentile(x, F.lit(float(q)))
    n = F.count(x)
    at = (n - 1).cast("double") * float(q)
    values = F.array_sort(F.collect_list(x))
    lo, hi = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    near = F.get(values, F.floor(at + 0.5).cast("int"))
    return {"lower": lo, "higher": hi, "nearest": near, "midpoint": (lo + hi) / 2}[method]
