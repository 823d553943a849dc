"""Features of series.  Those of the values alone are aggregate Columns; those of their order take a frame and ``order_by``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..core import groups
from ..core.groups import places, same_size
from ..core.prefix import numbered, running, series
from ..core.col import NAN, dbl, finite, ieee_div, ieee_ln, ieee_sqrt, over, quantile, to_col
from ..core.special import digamma


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


# --- aggregates

def query_mid_range(x) -> Column:
    return (F.max(dbl(x)) - F.min(dbl(x))) / 2


def query_symm_ratio(x) -> Column:
    return ieee_div(F.abs(F.avg(dbl(x)) - F.median(dbl(x))), F.max(dbl(x)) - F.min(dbl(x)))


def query_abs_energy(x) -> Column:
    return F.sum(dbl(x) * dbl(x))


def query_cv(x, ddof: int = 1) -> Column:
    return ieee_div(F.stddev_samp(dbl(x)) if ddof else F.stddev_pop(dbl(x)), F.avg(dbl(x)))


def query_range_count(x, lower: float, upper: float) -> Column:
    return F.count_if(dbl(x).between(lower, upper))


def first_digit(x) -> Column:
    """Leading digit of a finite number other than 0, else null."""
    a = F.abs(finite(x))
    return F.when(a > 0, F.substring(F.format_string("%.15e", a), 1, 1).cast("int"))


def query_first_digit_cnt(x) -> Column:
    """Counts of the leading digits 1 to 9."""
    d = first_digit(x)
    return F.array(*(F.count_if(d == k) for k in range(1, 10)))


query_benford = query_first_digit_cnt


# --- over distinct values

def query_count_uniques(df: DataFrame, x: str, by=None) -> DataFrame:
    by = _by(by)
    return df.groupBy(*by, x).count().groupBy(*by).agg(F.count_if(F.col("count") == 1).alias("value"))


def query_entropy(df: DataFrame, x: str, base: float = math.e, by=None) -> DataFrame:
    """Entropy of the values' frequencies: with n ln n sums, no window over the groups is needed."""
    by = _by(by)
    c = df.groupBy(*by, x).count()
    n = F.sum("count").cast("double")
    return c.groupBy(*by).agg(((F.log(n) - F.sum(F.col("count") * F.log("count")) / n) / math.log(base)).alias("value"))


def query_cond_entropy(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """H(x | y)."""
    by = _by(by)
    both = df.groupBy(*by, x, y).count()
    h = both.groupBy(*by, y).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log("count")).alias("s"))
    return h.groupBy(*by).agg((F.sum(F.col("n") * F.log("n") - F.col("s")) / F.sum("n")).alias("value"))


def query_mean_n_abs_max(df: DataFrame, x: str, n_maxima: int, by=None) -> DataFrame:
    by = _by(by)
    a = df.select(*by, F.abs(dbl(x)).alias("v")).filter("v IS NOT NULL")
    if not by:
        return a.orderBy(F.desc("v")).limit(n_maxima).agg(F.avg("v").alias("value"))
    w = Window.partitionBy(*by).orderBy(F.desc("v"))
    return a.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n_maxima).groupBy(*by).agg(F.avg("v").alias("value"))


# --- neighbours in the order

def _agg(df: DataFrame, by: list[str], order_by, pre: Callable[[WindowSpec], dict[str, Column]], out: Column, back: int = 0, ahead: int = 0) -> DataFrame:
    """An aggregate over columns that look so many rows back or ahead in the order."""
    d, w, own = series(df, by, order_by, back, ahead)
    return d.withColumns(pre(w)).filter(own).groupBy(*by).agg(out.alias("value"))


def _step(x) -> Callable[[WindowSpec], dict[str, Column]]:
    return lambda w: {"d_": dbl(x) - F.lag(dbl(x)).over(w)}


def query_mean_abs_change(df: DataFrame, x: str, order_by, by=None) -> DataFrame:
    by = _by(by)
    return _agg(df, by, order_by, _step(x), F.avg(F.abs("d_")), back=1)


def query_cid_ce(df: DataFrame, x: str, order_by, normalize: bool = False, by=None) -> DataFrame:
    by = _by(by)
    s = F.sum(F.col("d_") * F.col("d_"))
    return _agg(df, by, order_by, _step(x), ieee_div(F.sqrt(s), F.stddev_samp(dbl(x))) if normalize else F.sqrt(s), back=1)


def query_c3_stats(df: DataFrame, x: str, lag: int, order_by, by=None) -> DataFrame:
    by = _by(by)
    three = lambda w: {"p_": dbl(x) * F.lag(dbl(x), lag).over(w) * F.lag(dbl(x), 2 * lag).over(w)}
    return _agg(df, by, order_by, three, ieee_div(F.sum("p_"), F.count(dbl(x)) - 2 * lag), back=2 * lag)


def query_time_reversal_asymmetry_stats(df: DataFrame, x: str, n_lags: int, order_by, by=None) -> DataFrame:
    by = _by(by)

    def product(w: WindowSpec) -> dict[str, Column]:
        one, two = F.lead(dbl(x), n_lags).over(w), F.lead(dbl(x), 2 * n_lags).over(w)
        return {"p_": one * (two + dbl(x)) * (two - dbl(x))}

    return _agg(df, by, order_by, product, F.avg("p_"), ahead=2 * n_lags)


def query_auto_corr(df: DataFrame, x: str, lag: int, order_by, ddof: int = 0, normalize: bool = True, by=None) -> DataFrame:
    by = _by(by)
    d, w, own = series(df, by, order_by, ahead=lag)
    out = d.withColumn("y_", F.lead(dbl(x), lag).over(w)).filter(own)
    if not normalize:
        return out.groupBy(*by).agg(F.avg(dbl(x) * F.col("y_")).alias("value"))
    m = df.groupBy(*by).agg(F.avg(dbl(x)).alias("m_"), (F.var_samp(dbl(x)) if ddof else F.var_pop(dbl(x))).alias("v_"))
    out = out.join(m, by) if by else out.crossJoin(F.broadcast(m))  # one row
    return out.groupBy(*by).agg(ieee_div(F.avg((dbl(x) - F.col("m_")) * (F.col("y_") - F.col("m_"))), F.max("v_")).alias("value"))


def query_streak(df: DataFrame, where, order_by, by=None) -> DataFrame:
    """Runs of equal truth values: value, length, and the first row's order key."""
    by = _by(by)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    t = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    d = df.select(*by, *order, t.alias("t_"))
    d, w, own = series(d, by, order, back=1)
    d = d.withColumn("new_", (~F.col("t_").eqNullSafe(F.lag("t_").over(w))).cast("long")).filter(own)
    d = running(d, order[0], {"run_": "new_"}, by, ties=[F.col(o) for o in order[1:]])
    return d.groupBy(*by, "run_").agg(F.first("t_").alias("value"), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("begin")).drop("run_")


def query_longest_streak(df: DataFrame, where, order_by, by=None) -> DataFrame:
    return query_streak(df, where, order_by, by).groupBy(*_by(by)).agg(F.coalesce(F.max(F.when(F.col("value"), F.col("length"))), F.lit(0)).alias("value"))


def query_avg_streak(df: DataFrame, where, order_by, by=None) -> DataFrame:
    return query_streak(df, where, order_by, by).groupBy(*_by(by)).agg(F.coalesce(F.avg(F.when(F.col("value"), F.col("length"))), F.lit(0.0)).alias("value"))


def is_increasing(df: DataFrame, x: str, order_by, strict: bool = False, by=None) -> DataFrame:
    by = _by(by)
    d = F.col("d_")
    return _agg(df, by, order_by, _step(x), F.coalesce(F.bool_and(d > 0 if strict else d >= 0), F.lit(True)), back=1)


def is_decreasing(df: DataFrame, x: str, order_by, strict: bool = False, by=None) -> DataFrame:
    by = _by(by)
    d = F.col("d_")
    return _agg(df, by, order_by, _step(x), F.coalesce(F.bool_and(d < 0 if strict else d <= 0), F.lit(True)), back=1)


def integrate_trapz(df: DataFrame, y: str, x: str, by=None) -> DataFrame:
    """Trapezoid integral of y over x, in the order of x."""
    by = _by(by)
    part = lambda w: {"a_": (dbl(x) - F.lag(dbl(x)).over(w)) * (dbl(y) + F.lag(dbl(y)).over(w)) / 2}
    return _agg(df, by, x, part, F.coalesce(F.sum("a_"), F.lit(NAN)), back=1)


def detrend(df: DataFrame, x: str, order_by, method: str = "linear", by=None, name: str = "detrended") -> DataFrame:
    by = _by(by)
    if method == "mean":
        return df.withColumn(name, dbl(x) - (F.avg(dbl(x)).over(over(by)) if by else df.select(F.avg(dbl(x)).alias("m")).scalar()))
    order = order_by if isinstance(order_by, list) else [order_by]
    d = numbered(df.withColumn("order_", to_col(order[0])), "order_", "i_", by, ties=[to_col(o) for o in order[1:]]).drop("order_").withColumn("i_", (F.col("i_") - 1).cast("double"))
    fit = d.groupBy(*by).agg(F.regr_slope(dbl(x), F.col("i_")).alias("b_"), F.regr_intercept(dbl(x), F.col("i_")).alias("a_"))
    d = d.join(fit, by) if by else d.crossJoin(F.broadcast(fit))  # one row
    return d.withColumn(name, dbl(x) - F.col("a_") - F.col("b_") * F.col("i_")).drop("i_", "a_", "b_")


def query_similar_count(df: DataFrame, x: str, query: list[float], threshold: float, order_by, metric: str = "sqzl2", return_ratio: bool = False, by=None) -> DataFrame:
    """Windows of the series whose squared distance to the query is below the threshold; "sqzl2": both z-normalised."""
    by = _by(by)
    m = len(query)
    q = np.array(query, float)
    if metric == "sqzl2":
        q = (q - q.mean()) / max(q.std(), 1e-10)
    d, w, own = series(df, by, order_by, ahead=m - 1)
    d = d.withColumn("s_", F.collect_list(dbl(x)).over(w.rowsBetween(0, m - 1))).filter(own & (F.size("s_") == m))
    s = F.col("s_")
    if metric == "sqzl2":
        mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / m
        d = d.withColumn("m_", mean).withColumn("v_", F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - F.col("m_")) * (v - F.col("m_"))) / m)
        s = F.transform(s, lambda v: (v - F.col("m_")) / F.sqrt(F.greatest(F.col("v_"), F.lit(1e-10))))
    dist = F.aggregate(F.zip_with(s, F.array(*(F.lit(float(v)) for v in q)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    hit = F.count_if(dist < threshold)
    return d.groupBy(*by).agg((ieee_div(hit, F.count(F.lit(1))) if return_ratio else hit).alias("value"))


def query_permute_entropy(df: DataFrame, ts: str, order_by, tau: int = 1, n_dims: int = 3, base: float = math.e, by=None) -> DataFrame:
    """Entropy of the ordinal patterns of n_dims values, tau apart."""
    by = _by(by)
    d, w, own = series(df, by, order_by, ahead=tau * (n_dims - 1))
    parts = [F.lead(dbl(ts), tau * k).over(w) for k in range(n_dims)]
    d = d.withColumns({f"p{k}_": c for k, c in enumerate(parts)}).filter(own & F.col(f"p{n_dims - 1}_").isNotNull())
    order = F.transform(F.array_sort(F.array(*(F.struct(F.col(f"p{k}_").alias("v"), F.lit(k).alias("i")) for k in range(n_dims)))), lambda s: s["i"])
    return query_entropy(d.withColumn("pattern_", F.array_join(order.cast("array<string>"), ",")), "pattern_", base, by)


# --- kernels on one ordered group: each group is one task's work

def _kernel(df: DataFrame, cols: list, order_by, by, f, kind: str) -> DataFrame:
    """``f`` of arrays of the ordered columns, to a number or arrays of ``kind``, for each group."""
    return groups.kernel(df, cols, order_by, _by(by), groups.one_by_one(f), kind)


def lempel_ziv(b: np.ndarray) -> int:
    seen, i, k = set(), 0, 1
    s = b.astype(np.uint8).tobytes()
    n = len(s)
    while i < n:
        k = 1
        while i + k <= n and s[i : i + k] in seen:
            k += 1
        seen.add(s[i : i + k])
        i += k
    return len(seen)


def query_lempel_ziv(df: DataFrame, where, order_by, as_ratio: bool = True, by=None) -> DataFrame:
    t = (F.expr(where) if isinstance(where, str) else where).cast("int")
    return _kernel(df.withColumn("b_", t), ["b_"], order_by, by, lambda b: lempel_ziv(b > 0) / (len(b) if as_ratio else 1), "value double")


def _embed(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)


def _close(e: np.ndarray, r: float) -> np.ndarray:
    """For each row, how many rows are within r in the maximum norm (itself too), by blocks."""
    out = np.empty(len(e), np.int64)
    for i in range(0, len(e), 512):
        near = np.ones((min(512, len(e) - i), len(e)), bool)
        for k in range(e.shape[1]):
            near &= np.abs(e[i : i + 512, k, None] - e[None, :, k]) <= r
        out[i : i + 512] = near.sum(axis=1)
    return out


def sample_entropy(x: np.ndarray, ratio: float = 0.2, m: int = 2) -> float:
    x = x[np.isfinite(x)]
    if len(x) < m + 2:
        return NAN
    r = ratio * x.std()
    b = _close(_embed(x, m), r).sum() - (len(x) - m + 1)
    a = _close(_embed(x, m + 1), r).sum() - (len(x) - m)
    return math.log(b / a) if a > 0 and b > 0 else NAN


def approx_entropy(x: np.ndarray, m: int, level: float, scale_by_std: bool = True) -> float:
    x = x[np.isfinite(x)]
    if len(x) <= m + 1:
        return NAN
    r = level * (x.std(ddof=1) if scale_by_std else 1.0)
    phi = lambda k: float(np.log(_close(_embed(x, k), r) / (len(x) - k + 1)).mean())
    return abs(phi(m + 1) - phi(m))


def query_sample_entropy(df: DataFrame, ts: str, order_by, ratio: float = 0.2, m: int = 2, by=None) -> DataFrame:
    return _kernel(df, [ts], order_by, by, lambda x: sample_entropy(x, ratio, m), "value double")


def query_approx_entropy(df: DataFrame, ts: str, m: int, filtering_level: float, order_by, scale_by_std: bool = True, by=None) -> DataFrame:
    return _kernel(df, [ts], order_by, by, lambda x: approx_entropy(x, m, filtering_level, scale_by_std), "value double")


#: Points of a leaf of the tree of ``kth_distances``, and distances that it holds at once.
LEAF, CELLS = 32, 1 << 22


def leaves(x: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the points whose 2 ** depth equal parts are the leaves of a tree of cuts at the widest dimension's median."""
    n, depth = len(x), max(0, math.ceil(math.log2(max(len(x), 1) / LEAF)))
    order = np.arange(n)
    for level in range(depth):
        edges = (np.arange((1 << level) + 1) * n) >> level
        part = np.repeat(np.arange(1 << level), np.diff(edges))
        v = x[order]
        wide = (np.maximum.reduceat(v, edges[:-1]) - np.minimum.reduceat(v, edges[:-1])).argmax(axis=1)
        order = order[np.lexsort((v[np.arange(n), wide[part]], part))]
    return order, depth


def kth_distances(x: np.ndarray, k: int, dist: str = "l2") -> np.ndarray:
    """Each point's distance to the k-th nearest other point, exact: leaves of a tree meet only leaves that reach nearer than what is known."""
    n, d = x.shape

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # the last axis last, as (..., d) would be summed up
        out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        for j in range(d):
            diff = a[..., j] - b[..., j]
            out = out + diff * diff if dist == "l2" else np.maximum(out, np.abs(diff))
        return out

    order, depth = leaves(x)
    # parts of one size: the last places of shorter leaves hold nothing
    edges = (np.arange((1 << depth) + 1) * n) >> depth
    sizes = np.diff(edges)
    width = int(sizes.max())
    place = np.arange(width)
    full = place < sizes[:, None]
    v = np.where(full[:, :, None], x[order][np.minimum(edges[:-1, None] + place, n - 1)], np.inf)
    with np.errstate(invalid="ignore"):
        # boxes of all nodes, by level from the leaves up
        lo, hi = [v.min(axis=1)], [np.where(full[:, :, None], v, -np.inf).max(axis=1)]
        while len(lo[-1]) > 1:
            lo.append(np.minimum(lo[-1][::2], lo[-1][1::2]))
            hi.append(np.maximum(hi[-1][::2], hi[-1][1::2]))
        best = np.empty((len(v), width, k + 1))
        step = max(1, CELLS // (width * width))
        for i in range(0, len(v), step):
            own = distances(v[i : i + step, :, None, :], v[i : i + step, None, :, :])
            own[np.isnan(own)] = np.inf
            if width <= k:
                own = np.concatenate([own, np.full((*own.shape[:2], k + 1 - width), np.inf)], axis=2)
            best[i : i + step] = np.sort(np.partition(own, k, axis=2)[:, :, : k + 1], axis=2)
        far = np.where(full, best[:, :, k], -1.0).max(axis=1)
        # leaves of queries go down the tree together, some at a time
        for i in range(0, len(v), 4096):
            q = np.arange(i, min(i + 4096, len(v)))
            node = np.zeros(len(q), np.int64)
            for level in range(depth - 1, -1, -1):
                q, node = np.repeat(q, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
                gap = np.maximum(np.maximum(lo[level][node] - hi[0][q], lo[0][q] - hi[level][node]), 0.0)
                least = (gap * gap).sum(axis=1) if dist == "l2" else gap.max(axis=1)
                reach = least * (1 - 1e-12) < far[q]
                q, node = q[reach], node[reach]
            other = q != node
            q, node = q[other], node[other]
            # nearest leaves first: a round takes the next leaf of every query
            gap = np.maximum(np.maximum(lo[0][node] - hi[0][q], lo[0][q] - hi[0][node]), 0.0)
            least = (gap * gap).sum(axis=1) if dist == "l2" else gap.max(axis=1)
            o = np.lexsort((least, q))
            q, node, least = q[o], node[o], least[o]
            turn = np.arange(len(q)) - np.searchsorted(q, q)
            by_turn = np.argsort(turn, kind="stable")
            ends = np.searchsorted(turn[by_turn], np.arange(turn.max(initial=-1) + 2))
            for a, b in zip(ends[:-1], ends[1:]):
                at = by_turn[a:b]
                at = at[least[at] * (1 - 1e-12) < far[q[at]]]
                for c in range(0, len(at), step):
                    qs, ps = q[at[c : c + step]], node[at[c : c + step]]
                    got = distances(v[qs][:, :, None, :], v[ps][:, None, :, :])
                    got[np.isnan(got)] = np.inf
                    got = np.concatenate([best[qs], got], axis=2)
                    best[qs] = np.sort(np.partition(got, k, axis=2)[:, :, : k + 1], axis=2)
                    far[qs] = np.where(full[qs], best[qs, :, k], -1.0).max(axis=1)
    out = np.empty(n)
    out[order] = best[:, :, k][full]
    return np.sqrt(out) if dist == "l2" else out


def knn_entropy(x: np.ndarray, k: int = 3, dist: str = "l2") -> float:
    """Kozachenko and Leonenko's estimate; rows with a value that is not finite are left out."""
    x = x[np.isfinite(x).all(axis=1)]
    n, d = x.shape
    if n <= k:
        return NAN
    far = kth_distances(x, k, dist)
    ball = d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1) if dist == "l2" else d * math.log(2)
    with np.errstate(divide="ignore"):
        return float(digamma(np.array([n]))[0] - digamma(np.array([k]))[0] + ball + d * np.log(far).mean())


def query_knn_entropy(df: DataFrame, *features, k: int = 3, dist: str = "l2", by=None) -> DataFrame:
    return _kernel(df, list(features), None, by, lambda *xs: knn_entropy(np.column_stack(xs), k, dist), "value double")


def _copula(xs, k: int) -> float:
    x = np.column_stack(xs)
    x = x[np.isfinite(x).all(axis=1)]
    r = np.column_stack([pd.Series(c).rank().to_numpy() / len(c) for c in x.T]) if len(x) else x
    return -knn_entropy(r, k, "l2")


def query_copula_entropy(df: DataFrame, *features, k: int = 3, by=None) -> DataFrame:
    return _kernel(df, list(features), None, by, lambda *xs: _copula(xs, k), "value double")


def _cond_indep(x, y, z, k: int) -> float:
    return _copula([x, y, z], k) - _copula([y, z], k) - _copula([x, z], k)


def query_cond_indep(df: DataFrame, x, y, z, k: int = 3, by=None) -> DataFrame:
    return _kernel(df, [x, y, z], None, by, lambda a, b, c: _cond_indep(a, b, c, k), "value double")


def query_transfer_entropy(df: DataFrame, x, source, order_by, lag: int = 1, k: int = 3, by=None) -> DataFrame:
    return _kernel(df, [x, source], order_by, by, lambda a, s: _cond_indep(a[lag:], s[:-lag], a[:-lag], k), "value double")


def convolve_array(x: np.ndarray, kernel: list[float], fill_value: float = 0.0, method: str = "direct", mode: str = "full") -> np.ndarray:
    k = np.array(kernel, float)
    if len(k) < 2 or len(k) > len(x):
        raise ValueError("the kernel must have 2 values at least and be no longer than the series")
    x = np.where(np.isnan(x), fill_value, x)
    if method == "fft":
        n = len(x) + len(k) - 1
        full = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(k, n), n)
    else:
        full = np.convolve(x, k)
    n, m = len(x), len(k)
    return {"full": full, "same": full[(m - 1) // 2 : (m - 1) // 2 + n], "left": full[:n], "right": full[m - 1 :], "valid": full[m - 1 : n]}[mode]


def convolve(df: DataFrame, x, kernel: list[float], order_by, fill_value: float = 0.0, method: str = "direct", mode: str = "full", by=None) -> DataFrame:
    k = np.array(kernel, float)
    m = len(k)

    def one(a: np.ndarray) -> tuple:
        out = convolve_array(a, kernel, fill_value, method, mode)
        return np.arange(len(out)), out

    def many(sizes: np.ndarray, a: np.ndarray) -> tuple:
        if m < 2 or (sizes < m).any():
            raise ValueError("the kernel must have 2 values at least and be no longer than the series")
        a = np.where(np.isnan(a), fill_value, a)
        # each group's whole result lies m - 1 places further than the last one's
        at = np.arange(len(a)) + np.repeat(np.arange(len(sizes)) * (m - 1), sizes)
        full = np.zeros(len(a) + len(sizes) * (m - 1))
        for j, c in enumerate(k):
            full[at + j] += c * a
        begin = {"full": 0, "same": (m - 1) // 2, "left": 0, "right": m - 1, "valid": m - 1}[mode]
        got = sizes + {"full": m - 1, "valid": 1 - m}.get(mode, 0)
        i = places(got)
        return got, i, full[np.repeat(np.cumsum(sizes + m - 1) - (sizes + m - 1) + begin, got) + i]

    return groups.kernel(df, [x], order_by, _by(by), groups.one_by_one(one) if method == "fft" else many, "i long, value double")


def rfft(df: DataFrame, x, order_by, n: int | None = None, return_full: bool = False, by=None) -> DataFrame:
    def many(sizes: np.ndarray, a: np.ndarray) -> tuple:
        if np.isnan(a).any():
            raise ValueError("nulls")
        over_ = np.full(len(sizes), n) if n is not None else sizes
        got = over_ if return_full else over_ // 2 + 1
        out, first = np.empty(int(got.sum()), complex), np.cumsum(got) - got
        for _, at, rows in same_size(sizes):
            f = (np.fft.fft if return_full else np.fft.rfft)(a[rows], n, axis=1)
            out[first[at][:, None] + np.arange(f.shape[1])] = f
        return got, places(got), out.real.copy(), out.imag.copy()

    return groups.kernel(df, [x], order_by, _by(by), many, "i long, re double, im double")


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    values, weights, sizes = [], [], []
    for a, b in zip(y, w):
        values.append(a)
        weights.append(b)
        sizes.append(1)
        while len(values) > 1 and values[-2] > values[-1]:
            v, u, s = values.pop(), weights.pop(), sizes.pop()
            values[-1] = (values[-1] * weights[-1] + v * u) / (weights[-1] + u)
            weights[-1] += u
            sizes[-1] += s
    return np.repeat(values, sizes)


def isotonic_regression(df: DataFrame, y, order_by, weights=None, increasing: bool = True, by=None) -> DataFrame:
    def run(a: np.ndarray, *w: np.ndarray) -> tuple:
        s = 1.0 if increasing else -1.0
        return np.arange(len(a)), s * pava(s * a, w[0] if w else np.ones(len(a)))

    return _kernel(df, [y] + ([weights] if weights is not None else []), order_by, by, run, "i long, value double")


def spline_fit(x: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """Values of the cubic smoothing spline at x: (W + lam K) f = y, solved through its band."""
    n = len(x)
    if n < 3:
        return y.copy()
    h = np.diff(x)
    if (h <= 0).any():
        raise ValueError("x must increase strictly")
    # second differences Q (n x n-2), tridiagonal R
    q0, q1, q2 = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    a = (h[:-1] + h[1:]) / 3 + lam * (q0 * q0 + q1 * q1 + q2 * q2)
    b = h[1:-1] / 6 + lam * (q1[:-1] * q0[1:] + q2[:-1] * q1[1:])
    c = lam * q2[:-2] * q0[2:]
    r = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
    m = n - 2
    # LDL' of the pentadiagonal matrix
    d, l1, l2 = np.zeros(m), np.zeros(m), np.zeros(m)
    for i in range(m):
        d[i] = a[i] - (l1[i - 1] ** 2 * d[i - 1] if i > 0 else 0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
        if i + 1 < m:
            l1[i] = (b[i] - (l1[i - 1] * l2[i - 1] * d[i - 1] if i > 0 else 0)) / d[i]
        if i + 2 < m:
            l2[i] = c[i] / d[i]
    z = r.copy()
    for i in range(m):
        z[i] -= (l1[i - 1] * z[i - 1] if i > 0 else 0) + (l2[i - 2] * z[i - 2] if i > 1 else 0)
    z /= d
    for i in range(m - 1, -1, -1):
        z[i] -= (l1[i] * z[i + 1] if i + 1 < m else 0) + (l2[i] * z[i + 2] if i + 2 < m else 0)
    out = y.astype(float).copy()
    out[:-2] -= lam * q0 * z
    out[1:-1] -= lam * q1 * z
    out[2:] -= lam * q2 * z
    return out


def smooth_spline(df: DataFrame, x, y, lambda_: float, by=None) -> DataFrame:
    return _kernel(df, [x, y], [x], by, lambda a, b: (a, spline_fit(a, b, lambda_)), "x double, value double")


def add_at(df: DataFrame, indices: str, values: str, buffer_size: int | None = None) -> DataFrame:
    """(i, value): for each place of the buffer the sum of the values that point there."""
    s = df.groupBy(to_col(indices).cast("long").alias("i")).agg(F.sum(dbl(values)).alias("v_"))
    size = buffer_size if buffer_size is not None else (df.agg(F.max(to_col(indices)).alias("m")).first().m or 0) + 1
    return df.sparkSession.range(size).withColumnRenamed("id", "i").join(s, "i", "left").select("i", F.coalesce("v_", F.lit(0.0)).alias("value"))


__all__ = [n for n in dir() if n.startswith(("query_", "is_"))] + ["convolve", "rfft", "isotonic_regression", "smooth_spline", "add_at", "ieee_ln", "ieee_sqrt", "quantile"]
