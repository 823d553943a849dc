"""Drift, binning and encoding statistics.  All group first and then work on the few bins or categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.col import INF, dbl, finite, ieee_div, ieee_ln, to_col

FLOOR = 1e-4


def breakpoints(df: DataFrame, x: str, n_bins: int) -> list[float]:
    """Different inner quantiles (linear) of the finite values."""
    qs = [k / n_bins for k in range(1, n_bins)]
    row = df.agg(F.percentile(finite(x), F.array(*map(F.lit, qs))).alias("q")).first()
    return sorted(set(row.q or []))


def bucket(x, points: list[float]) -> Column:
    """The upper end of the right-closed bin that x falls in; infinity beyond the last point."""
    x = dbl(x)
    out = None
    for p in points:
        out = (F if out is None else out).when(x <= p, F.lit(float(p)))
    return F.lit(INF) if out is None else out.otherwise(F.lit(INF))


def _psi(both: DataFrame, key: str) -> DataFrame:
    new, base = F.greatest(F.col("new_pct"), F.lit(FLOOR)), F.greatest(F.col("base_pct"), F.lit(FLOOR))
    return both.select(key, "new_count", "base_count", new.alias("new_pct"), base.alias("base_pct"), ((new - base) * F.log(new / base)).alias("psi"))


def _shares(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """Counts and shares of two tables of keys, joined."""
    x, y = a.groupBy(key).agg(F.count(F.lit(1)).alias("base_count")), b.groupBy(key).agg(F.count(F.lit(1)).alias("new_count"))
    nx, ny = a.count(), b.count()
    out = x.join(y, x[key].eqNullSafe(y[key]), how).select(F.coalesce(x[key], y[key]).alias(key), F.coalesce("base_count", F.lit(0)).alias("base_count"), F.coalesce("new_count", F.lit(0)).alias("new_count"))
    return out.withColumns({"base_pct": ieee_div("base_count", nx), "new_pct": ieee_div("new_count", ny)})


def psi(df: DataFrame, new: str, baseline: str, n_bins: int = 10, return_report: bool = False) -> DataFrame:
    """Population stability index on the baseline's quantile bins."""
    out = psi_w_breakpoints(df, new, baseline, breakpoints(df, baseline, n_bins))
    return out if return_report else out.agg(F.sum("psi").alias("psi"))


def psi_w_breakpoints(df: DataFrame, new: str, baseline: str, points: list[float]) -> DataFrame:
    base, fresh = (df.filter(finite(c).isNotNull()).select(bucket(c, points).alias("upper")) for c in (baseline, new))
    return _psi(_shares(base, fresh, "upper", "left"), "upper")


def psi_discrete(df: DataFrame, new: str, baseline: str, return_report: bool = False) -> DataFrame:
    out = _psi(_shares(df.select(F.col(baseline).alias("category")), df.select(F.col(new).alias("category")), "category", "full"), "category")
    return out if return_report else out.agg(F.sum("psi").alias("psi"))


def _woe(df: DataFrame, key: Column, target: str) -> DataFrame:
    g = df.filter(to_col(target).isNotNull()).select(key.alias("value"), to_col(target).cast("int").alias("t")).filter("value IS NOT NULL").groupBy("value").agg(F.sum("t").cast("double").alias("events"), F.count(F.lit(1)).cast("double").alias("n"))
    s = g.agg(F.sum("events").alias("all_e"), F.sum("n").alias("all_n"))
    g = g.crossJoin(F.broadcast(s))  # one row
    e, ne = F.col("events"), F.col("n") - F.col("events")
    pe, pn = (e + 1) / (F.col("all_e") + 2), (ne + 1) / (F.col("all_n") - F.col("all_e") + 2)
    woe = F.log(pe / pn)
    return g.select("value", woe.alias("woe"), ((pe - pn) * woe).alias("iv"))


def woe_discrete(df: DataFrame, x: str, target: str) -> DataFrame:
    """Weight of evidence of each category: log of the smoothed share of events over that of the others."""
    return _woe(df, F.col(x), target).select("value", "woe")


def info_value_discrete(df: DataFrame, x: str, target: str, return_sum: bool = True) -> DataFrame:
    w = _woe(df, F.col(x), target).select("value", "iv")
    return w.agg(F.sum("iv").alias("iv")) if return_sum else w


def woe(df: DataFrame, x: str, target: str, n_bins: int = 10) -> DataFrame:
    return _woe(df.filter(finite(x).isNotNull()), bucket(x, breakpoints(df, x, n_bins)), target).select("value", "woe")


def info_value(df: DataFrame, x: str, target: str, n_bins: int = 10, return_sum: bool = True) -> DataFrame:
    w = _woe(df.filter(finite(x).isNotNull()), bucket(x, breakpoints(df, x, n_bins)), target).select("value", "iv")
    return w.agg(F.sum("iv").alias("iv")) if return_sum else w


def target_encode(df: DataFrame, s: str, target: str, min_samples_leaf: int = 20, smoothing: float = 10.0) -> DataFrame:
    """Each category's mean target, drawn to the overall mean the fewer rows it has."""
    g = df.filter(to_col(s).isNotNull() & to_col(target).isNotNull()).groupBy(F.col(s).alias("value")).agg(F.sum(dbl(target)).alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    g = g.crossJoin(F.broadcast(g.agg((F.sum("t") / F.sum("n")).alias("prior"))))  # one row
    a = 1 / (1 + F.exp(-(F.col("n") - min_samples_leaf) / smoothing))
    return g.select("value", (F.col("prior") * (1 - a) + F.col("t") / F.col("n") * a).alias("to"))


__all__ = ["psi", "psi_discrete", "psi_w_breakpoints", "woe", "woe_discrete", "info_value", "info_value_discrete", "target_encode", "ieee_ln"]
