"""Row-wise numeric functions.  All return a Column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.col import INF, NAN, dbl, finite, ieee_div, ieee_ln, over, to_col, total
from ..core.special import digamma as _digamma


def l_inf_horizontal(*v, normalize: bool = False) -> Column:
    cols = [F.abs(dbl(c)) for c in v]
    out = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return out / len(cols) if normalize else out


def l2_sq_horizontal(*v, normalize: bool = False) -> Column:
    out = total(F.coalesce(dbl(c) * dbl(c), F.lit(0.0)) for c in v)
    return out / len(v) if normalize else out


def l1_horizontal(*v, normalize: bool = False) -> Column:
    out = total(F.coalesce(F.abs(dbl(c)), F.lit(0.0)) for c in v)
    return out / len(v) if normalize else out


def _zipped(a, b, f) -> Column:
    a, b = to_col(a), to_col(b)
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def list_dot(a, b) -> Column:
    """Dot product of two arrays; null where their lengths differ."""
    return _zipped(a, b, lambda x, y: x * y)


def list_l1_dist(a, b) -> Column:
    return _zipped(a, b, lambda x, y: F.abs(x - y))


def list_sql2_dist(a, b) -> Column:
    return _zipped(a, b, lambda x, y: (x - y) * (x - y))


arr_dot, arr_l1_dist, arr_sql2_dist = list_dot, list_l1_dist, list_sql2_dist


def jaccard_row(a, b) -> Column:
    """Common distinct elements over raw lengths less the common ones."""
    a, b = to_col(a), to_col(b)
    both = F.size(F.array_intersect(a, b))
    return ieee_div(both, F.size(a) + F.size(b) - both)


def jaccard_col(a, b, count_null: bool = False) -> Column:
    """Jaccard similarity of two columns' sets of values, as an aggregate."""
    a, b = to_col(a), to_col(b)
    sa, sb = F.collect_set(a), F.collect_set(b)
    both, either = F.size(F.array_intersect(sa, sb)), F.size(F.array_union(sa, sb))
    if count_null:
        na, nb = F.max(a.isNull().cast("int")), F.max(b.isNull().cast("int"))
        both, either = both + na * nb, either + F.greatest(na, nb)
    return ieee_div(both, either)


def list_amax(x) -> Column:
    """Place of the greatest element, from 0."""
    x = to_col(x)
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def _vector(f, kind: str):
    @F.pandas_udf(kind)
    def run(*xs: pd.Series) -> pd.Series:
        return f(*xs)

    return run


def gcd(x, y) -> Column:
    def run(a, b):
        ok = a.notna() & b.notna()
        return pd.Series(np.gcd(a.fillna(0).astype("int64"), b.fillna(0).astype("int64")), dtype="Int64").where(ok.to_numpy())

    return _vector(run, "long")(to_col(x).cast("long"), to_col(y).cast("long"))


def lcm(x, y) -> Column:
    x, y = to_col(x).cast("long"), to_col(y).cast("long")
    g = gcd(x, y)
    return F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise(F.abs(x * y / F.greatest(g, F.lit(1))).cast("long"))


def haversine(x_lat, x_long, y_lat, y_long) -> Column:
    """Great-circle kilometres, radius 6371."""
    a1, o1, a2, o2 = (F.radians(dbl(c)) for c in (x_lat, x_long, y_lat, y_long))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def gamma(x) -> Column:
    def run(a):
        import math

        def one(v: float) -> float:
            if v != v or v < 0:
                return NAN
            try:
                return INF if v == 0 else math.gamma(v)
            except OverflowError:
                return INF

        return a.map(one, na_action="ignore").astype(float)

    return _vector(run, "double")(dbl(x))


def digamma(x) -> Column:
    return _vector(lambda a: pd.Series(_digamma(a.to_numpy(float))).where(a.notna().to_numpy()), "double")(dbl(x))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-dbl(x)))


def logit(x) -> Column:
    x = dbl(x)
    return F.when((x < 0) | (x > 1) | F.isnan(x), F.lit(NAN)).when(x == 0, F.lit(-INF)).when(x == 1, F.lit(INF)).otherwise(F.log(F.try_divide(x, 1 - x)))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), dbl(x))


def fract(x) -> Column:
    return dbl(x) % 1


def trunc(x) -> Column:
    x = dbl(x)
    odd = F.isnan(x) | (F.abs(x) == INF)
    return F.when(odd, x).otherwise(x - x % 1)


def sinc(x) -> Column:
    x = dbl(x)
    y = F.when(x == 0, F.lit(1e-20)).otherwise(x) * np.pi
    return F.sin(y) / y


def xlogy(x, y) -> Column:
    x, y = dbl(x), dbl(y)
    return F.when((x == 0) & ~F.isnan(y), F.lit(0.0)).otherwise(x * ieee_ln(y))


def next_up(x) -> Column:
    return _vector(lambda a: pd.Series(np.nextafter(a.to_numpy(float), np.inf)).where(a.notna().to_numpy()), "double")(dbl(x))


def next_down(x) -> Column:
    return _vector(lambda a: pd.Series(np.nextafter(a.to_numpy(float), -np.inf)).where(a.notna().to_numpy()), "double")(dbl(x))


# --- over a group of rows


def _all(e: Column, by, of: DataFrame | None) -> Column:
    """An aggregate beside each row: over the row's group, or as a scalar subquery over the frame ``of``."""
    if by is None and of is not None:
        return of.select(e.alias("v")).scalar()
    return e.over(over(by))


# ``of``: the frame itself, where there is no group; without either, the window is one task

def center(x, by=None, of: DataFrame | None = None) -> Column:
    return dbl(x) - _all(F.avg(dbl(x)), by, of)


def z_normalize(x, by=None, of: DataFrame | None = None) -> Column:
    return ieee_div(center(x, by, of), _all(F.stddev_samp(dbl(x)), by, of))


def softmax(x, by=None, of: DataFrame | None = None) -> Column:
    return F.exp(dbl(x)) / _all(F.sum(F.exp(dbl(x))), by, of)


def integrate_trapz_pairs(y, x, order_by=None, by=None) -> Column:
    """A row's part of the trapezoid integral of y over x: sum it."""
    w = over(by, order_by or x)
    return (dbl(x) - F.lag(dbl(x)).over(w)) * (dbl(y) + F.lag(dbl(y)).over(w)) / 2


def steps(x, order_by, by=None) -> Column:
    """Difference to the row before in the given order."""
    return dbl(x) - F.lag(dbl(x)).over(over(by, order_by))


def is_finite(x) -> Column:
    return finite(x).isNotNull()
