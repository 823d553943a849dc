"""Statistics and tests.  Means and moments are aggregate Columns; tests are Columns too where one pass will do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import groups, special
from ..core.prefix import exact_quantile, numbered, running, with_totals
from ..core.col import NAN, dbl, finite, ieee_div, ieee_ln, ieee_sqrt, quantile, to_col

TEST = "struct<statistic: double, pvalue: double>"


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def hmean(x) -> Column:
    return ieee_div(F.count(dbl(x)), F.sum(ieee_div(1.0, x)))


def gmean(x) -> Column:
    return F.exp(F.avg(ieee_ln(x)))


def weighted_mean(x, w, is_normalized: bool = False) -> Column:
    s = F.sum(dbl(x) * dbl(w))
    return s if is_normalized else ieee_div(s, F.sum(dbl(w)))


def weighted_hmean(x, w, is_normalized: bool = False) -> Column:
    top = F.lit(1.0) if is_normalized else F.sum(dbl(w))
    return ieee_div(top, F.sum(ieee_div(w, x)))


def weighted_gmean(x, w, is_normalized: bool = False) -> Column:
    s = F.sum(dbl(w) * ieee_ln(x))
    return F.exp(s if is_normalized else ieee_div(s, F.sum(dbl(w))))


def weighted_cov(x, y, w) -> Column:
    """From moments around the rows' own weighted means, in one pass."""
    x, y, w = dbl(x), dbl(y), dbl(w)
    s = F.sum(w)
    return ieee_div(F.sum(w * x * y), s) - ieee_div(F.sum(w * x), s) * ieee_div(F.sum(w * y), s)


def weighted_var(x, w, freq_weights: bool = False) -> Column:
    x, w = dbl(x), dbl(w)
    s = F.sum(w)
    return ieee_div(weighted_cov(x, x, w) * s, s - 1) if freq_weights else weighted_cov(x, x, w)


def weighted_corr(x, y, w) -> Column:
    return ieee_div(weighted_cov(x, y, w), ieee_sqrt(weighted_cov(x, x, w) * weighted_cov(y, y, w)))


def cosine_sim(x, y) -> Column:
    x, y = dbl(x), dbl(y)
    return ieee_div(F.sum(x * y), ieee_sqrt(F.sum(x * x)) * ieee_sqrt(F.sum(y * y)))


def weighted_cosine_sim(x, y, w) -> Column:
    x, y, w = dbl(x), dbl(y), dbl(w)
    return ieee_div(F.sum(w * x * y), ieee_sqrt(F.sum(w * x * x)) * ieee_sqrt(F.sum(w * y * y)))


def pearson(x, y) -> Column:
    x, y = dbl(x), dbl(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ieee_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def winsorize(df: DataFrame, x: str, q_low: float = 0.05, q_high: float = 0.95, method: str = "nearest", name: str | None = None, by=None) -> DataFrame:
    """The frame with x clipped to its quantiles."""
    by = _by(by)
    q = df.groupBy(*by).agg(quantile(x, q_low, method).alias("q_lo"), quantile(x, q_high, method).alias("q_hi"))
    out = df.join(q, by) if by else df.crossJoin(F.broadcast(q))  # one row
    c = dbl(x)
    return out.withColumn(name or x, F.when(c < F.col("q_lo"), F.col("q_lo")).when(c > F.col("q_hi"), F.col("q_hi")).otherwise(c)).drop("q_lo", "q_hi")


# --- tails: vectorised over the few rows that an aggregate leaves


def _tail(f):
    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([NAN if any(v is None or v != v for v in row) else f(*row) for row in zip(*xs)], dtype=float)

    return run


def _sides(upper: Column, alternative: str) -> Column:
    """p-value from P(T > t)."""
    return {"two-sided": 2 * F.least(upper, 1 - upper), "greater": upper, "less": 1 - upper}[alternative]


def _t_struct(t: Column, df: Column, alternative: str) -> Column:
    return F.struct(t.alias("statistic"), _sides(_tail(special.t_sf)(t, df), alternative).alias("pvalue"))


def _two(m1, v1, n1, m2, v2, n2, equal_var: bool, alternative: str) -> Column:
    if equal_var:
        df = n1 + n2 - 2
        pooled = ieee_div((n1 - 1) * v1 + (n2 - 1) * v2, df)
        return _t_struct(ieee_div(m1 - m2, ieee_sqrt(pooled * (ieee_div(1.0, n1) + ieee_div(1.0, n2)))), df, alternative)
    a, b = ieee_div(v1, n1), ieee_div(v2, n2)
    return _t_struct(ieee_div(m1 - m2, ieee_sqrt(a + b)), ieee_div((a + b) * (a + b), ieee_div(a * a, n1 - 1) + ieee_div(b * b, n2 - 1)), alternative)


def _moments(x) -> tuple[Column, Column, Column]:
    x = finite(x)
    return F.avg(x), F.var_samp(x), F.count(x).cast("double")


def ttest_ind(var1, var2, alternative: str = "two-sided", equal_var: bool = False) -> Column:
    return _two(*_moments(var1), *_moments(var2), equal_var, alternative)


def ttest_1samp(var1, pop_mean: float, alternative: str = "two-sided") -> Column:
    m, v, n = _moments(var1)
    return _t_struct(ieee_div(m - pop_mean, ieee_sqrt(ieee_div(v, n))), n - 1, alternative)


def ttest_ind_from_stats(var1, mean: float, var: float, cnt: int, alternative: str = "two-sided", equal_var: bool = False) -> Column:
    return _two(*_moments(var1), F.lit(float(mean)), F.lit(float(var)), F.lit(float(cnt)), equal_var, alternative)


def _k2(n: float, skew: float, kurt: float) -> float:
    """K squared from the count, the skewness and the kurtosis (3 for a normal distribution)."""
    import math

    if n < 20:
        return NAN
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    r = y / math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(r) / math.sqrt(0.5 * math.log(w2))
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    s = (kurt - 3 * (n - 1) / (n + 1)) / math.sqrt(v)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / (b1 * b1)))
    cube = (1 - 2 / a) / (1 + s * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(cube) ** (1 / 3), cube)) / math.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def normal_test(x) -> Column:
    """D'Agostino and Pearson's K squared; NaN below 20 values or without spread."""
    x = finite(x)
    k2 = _tail(_k2)(F.count(x).cast("double"), F.skewness(x), F.kurtosis(x) + 3)
    return F.struct(k2.alias("statistic"), F.exp(-k2 / 2).alias("pvalue"))


# --- frame-level tests


def ks_2samp(df: DataFrame, var1: str, var2: str, alpha: float = 0.05, by=None) -> DataFrame:
    """Greatest distance of two empirical distributions, and the critical value at ``alpha`` (the field is named pvalue); 0 and NaN if either has 30 values or fewer."""
    by = _by(by)
    one = df.select(*by, finite(var1).alias("v"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    two = df.select(*by, finite(var2).alias("v"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    counts = one.unionByName(two).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    d = with_totals(running(counts, "v", {"a_upto": "a", "b_upto": "b"}, by), {"a_all": "a", "b_all": "b"}, by)
    d = d.select(*by, "a", "b", F.abs(ieee_div("a_upto", "a_all") - ieee_div("b_upto", "b_all")).alias("d"))
    n1, n2 = F.sum("a"), F.sum("b")
    enough = (n1 > 30) & (n2 > 30)
    import math

    c = math.sqrt(-0.5 * math.log(alpha / 2))
    return d.groupBy(*by).agg(F.when(enough, F.max("d")).otherwise(0.0).alias("statistic"), F.when(enough, c * F.sqrt(ieee_div(n1 + n2, n1 * n2))).otherwise(F.lit(NAN)).alias("pvalue"))


def f_test(df: DataFrame, *variables: str, group: str) -> DataFrame:
    """One-way ANOVA of each variable against the group, one row a variable."""
    from functools import reduce

    out = []
    for v in variables:
        g = df.filter(to_col(group).isNotNull() & finite(v).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(dbl(v)).alias("m"), (F.var_pop(dbl(v)) * F.count(F.lit(1))).alias("within"))
        s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("within").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("l"))
        between = F.col("q") - ieee_div(F.col("l") * F.col("l"), "n")
        f = ieee_div(ieee_div(between, F.col("k") - 1), ieee_div("within", F.col("n") - F.col("k")))
        out.append(s.select(F.lit(v).alias("variable"), f.alias("statistic"), _tail(special.f_sf)(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("pvalue")))
    return reduce(DataFrame.unionByName, out)


def chi2(df: DataFrame, var1: str, var2: str, return_full: bool = False) -> DataFrame:
    """Test of independence over the table of all pairs of distinct values.

    Cells that no row falls in count with their expectation, which follows from the margins: the sum over empty cells is the
    total less the expectations of the cells that exist, so no cross of the values is made unless ``return_full`` asks for it.
    """
    cells = df.filter(to_col(var1).isNotNull() & to_col(var2).isNotNull()).groupBy(F.col(var1).alias("a"), F.col(var2).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("observed"))
    rows, cols = cells.groupBy("a").agg(F.sum("observed").alias("na")), cells.groupBy("b").agg(F.sum("observed").alias("nb"))
    total = cells.agg(F.sum("observed").alias("n"))
    if return_full:
        # the answer itself is the cross of the distinct values
        full = rows.crossJoin(cols).crossJoin(F.broadcast(total)).join(cells, ["a", "b"], "left")
        return full.select(F.col("a").alias(var1), F.col("b").alias(var2), F.coalesce("observed", F.lit(0.0)).alias("observed"), (F.col("na") * F.col("nb") / F.col("n")).alias("expected"))
    dims = rows.agg(F.count(F.lit(1)).cast("double").alias("ra")).crossJoin(cols.agg(F.count(F.lit(1)).cast("double").alias("cb"))).crossJoin(total)  # one row each
    e = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total)).select("observed", (F.col("na") * F.col("nb") / F.col("n")).alias("e"))
    s = e.agg(F.sum((F.col("observed") - F.col("e")) * (F.col("observed") - F.col("e")) / F.col("e")).alias("s"), F.sum("e").alias("seen")).crossJoin(dims)
    stat = F.col("s") + F.col("n") - F.col("seen")
    return s.select(stat.alias("statistic"), _tail(special.chi2_sf)(stat, (F.col("ra") - 1) * (F.col("cb") - 1)).alias("pvalue"))


def ranks(df: DataFrame, x: str, name: str = "rank", by=None, method: str = "average") -> DataFrame:
    """Ranks of the values through counts of distinct values: ties by average, min, max or dense."""
    by = _by(by)
    counts = df.filter(to_col(x).isNotNull()).groupBy(*by, F.col(x).alias("rank_value")).agg(F.count(F.lit(1)).alias("rank_n"))
    counts = running(counts.withColumn("rank_one", F.lit(1).cast("long")), "rank_value", {"rank_upto": "rank_n", "rank_dense": "rank_one"}, by)
    upto = F.col("rank_upto")
    r = {"average": upto - (F.col("rank_n") - 1) / 2, "min": upto - F.col("rank_n") + 1, "max": upto, "dense": F.col("rank_dense")}[method]
    table = counts.select(*(F.col(b).alias(f"rank_by_{i}") for i, b in enumerate(by)), "rank_value", r.cast("double").alias(name))
    same = [F.col(b).eqNullSafe(F.col(f"rank_by_{i}")) for i, b in enumerate(by)] + [F.col(x) == F.col("rank_value")]
    return df.join(table, same, "left").select(*(F.col(f"`{c}`") for c in df.columns), name)


def mann_whitney_u(df: DataFrame, var1: str, var2: str, alternative: str = "two-sided") -> DataFrame:
    """U of the first sample with tie correction and continuity, from counts of distinct values."""
    one = df.select(finite(var1).alias("v"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    two = df.select(finite(var2).alias("v"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    c = one.unionByName(two).filter("v IS NOT NULL").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("t", F.col("a") + F.col("b"))
    r = running(c, "v", {"upto": "t"}).withColumn("r", F.col("upto") - (F.col("t") - 1) / 2).agg(F.sum(F.col("r") * F.col("a")).alias("r1"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = {"two-sided": F.greatest(u1, n1 * n2 - u1), "greater": u1, "less": n1 * n2 - u1}[alternative]
    n = n1 + n2
    sd = ieee_sqrt(n1 * n2 / 12 * ((n + 1) - ieee_div("ties", n * (n - 1))))
    p = _tail(special.norm_sf)(ieee_div(u - n1 * n2 / 2 - 0.5, sd))
    return r.select(u1.alias("statistic"), (F.least(2 * p, F.lit(1.0)) if alternative == "two-sided" else p).alias("pvalue"))


def xi_corr(df: DataFrame, x: str, y: str, seed: int = 42, return_p: bool = False) -> DataFrame:
    """Chatterjee's coefficient; ties in x in an order drawn from the seed."""
    d = df.select(dbl(x).alias("x"), dbl(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    d = ranks(d, "y", "r", method="max").withColumn("neg", -F.col("y"))
    d = ranks(d, "neg", "l", method="max")
    # the row before in the order of x, by its number
    d = numbered(d.select("x", "y", "r", "l"), "x", "i", ties=[F.xxhash64(F.lit(seed), "x", "y"), F.col("y")])
    d = d.join(d.select((F.col("i") + 1).alias("i"), F.col("r").alias("r_before")), "i", "left").withColumn("step", F.abs(F.col("r") - F.col("r_before")))
    n = F.count(F.lit(1)).cast("double")
    s = d.agg(n.alias("n"), F.sum("step").alias("s"), F.sum("l").alias("l1"), F.sum(F.col("l") * F.col("l")).alias("l2"))
    xi = 1 - ieee_div(F.col("n") * F.col("s"), 2 * (F.col("n") * F.col("l1") - F.col("l2")))
    out = s.select(xi.alias("statistic"), "n")
    if not return_p:
        return out.select("statistic")
    p = _tail(special.norm_sf)(F.col("statistic") * F.sqrt(F.col("n")) / (2 / 5) ** 0.5)
    return out.select("statistic", F.when(F.col("n") >= 30, p).otherwise(F.lit(NAN)).alias("pvalue"))


def bicor(df: DataFrame, x: str, y: str, c: float = 9.0) -> DataFrame:
    """Biweight midcorrelation."""
    d = df.select(dbl(x).alias("x"), dbl(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    center = {v: F.lit(exact_quantile(d, v, 0.5)).cast("double") for v in "xy"}
    d = d.withColumns({f"m{v}": c for v, c in center.items()})
    d = d.withColumns({f"d{v}": F.lit(exact_quantile(d, F.abs(F.col(v) - c), 0.5)).cast("double") for v, c in center.items()})

    def part(v: str, m: str, s: str) -> Column:
        u = ieee_div(F.col(v) - F.col(m), c * F.col(s))
        return F.when(F.abs(u) < 1, (F.col(v) - F.col(m)) * (1 - u * u) * (1 - u * u)).otherwise(0.0)

    d = d.select(part("x", "mx", "dx").alias("a"), part("y", "my", "dy").alias("b"))
    return d.agg(ieee_div(F.sum(F.col("a") * F.col("b")), ieee_sqrt(F.sum(F.col("a") * F.col("a"))) * ieee_sqrt(F.sum(F.col("b") * F.col("b")))).alias("statistic"))


#: Rows of a group up to which Kendall's pairs are looked at one by one, for many groups of a size together; and pairs at once.
PAIRED, PAIRS = 64, 1 << 21


def _inversions(v: np.ndarray) -> int:
    total, width, v = 0, 1, v.copy()
    n = len(v)
    while width < n:
        for i in range(0, n - width, 2 * width):
            a, b = v[i : i + width], v[i + width : i + 2 * width]
            total += len(a) * len(b) - int(np.searchsorted(a, b, "right").sum())
            v[i : i + 2 * width] = np.sort(v[i : i + 2 * width], kind="stable")
        width *= 2
    return total


def _tau_of_many(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tau-b of each row."""
    n = x.shape[1]
    i, j = np.triu_indices(n, 1)
    out = np.empty(len(x))
    step = max(1, PAIRS // max(len(i), 1))
    sign = lambda a: (a[:, i] > a[:, j]).astype(np.int8) - (a[:, i] < a[:, j])
    for at in range(0, len(x), step):
        dx, dy = sign(x[at : at + step]), sign(y[at : at + step])
        bottom = np.sqrt(np.count_nonzero(dx, axis=1).astype(float) * np.count_nonzero(dy, axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + step] = np.where(bottom > 0, (dx * dy).sum(axis=1) / bottom, NAN)
    return out


def _tau(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b of one long series, n log n."""
    order = np.lexsort((y, x))
    d = pd.DataFrame({"x": x[order], "y": y[order]})
    n = len(d)
    pairs = lambda c: float((c * (c - 1) // 2).sum())
    n0, n1, n2 = n * (n - 1) / 2, pairs(d.groupby("x").size().to_numpy()), pairs(d.groupby("y").size().to_numpy())
    n3 = pairs(d.groupby(["x", "y"]).size().to_numpy())
    bottom = ((n0 - n1) * (n0 - n2)) ** 0.5
    return (n0 - n1 - n2 + n3 - 2 * _inversions(d["y"].to_numpy(float))) / bottom if bottom else NAN


def kendall_tau(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Tau-b; pairs with a null or NaN are left out.  A group is one task's work, n log n: give ``by`` for large tables."""

    def many(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        group = np.repeat(np.arange(len(sizes)), sizes)
        ok = ~(np.isnan(x) | np.isnan(y))
        x, y, sizes = x[ok], y[ok], np.bincount(group[ok], minlength=len(sizes))
        out = np.full(len(sizes), NAN)
        for n, at, rows in groups.same_size(sizes):
            if 1 < n <= PAIRED:
                out[at] = _tau_of_many(x[rows], y[rows])
            elif n > PAIRED:
                out[at] = [_tau(x[r], y[r]) for r in rows]
        return np.ones(len(sizes), np.int64), out

    return groups.kernel(df, [x, y], None, _by(by), many, "statistic double")


def corr(df: DataFrame, x: str, y: str, method: str = "pearson", seed: int = 42) -> DataFrame:
    if method == "pearson":
        return df.agg(pearson(x, y).alias("statistic"))
    if method == "spearman":
        d = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        return ranks(ranks(d, "x", "rx"), "y", "ry").agg(pearson("rx", "ry").alias("statistic"))
    return {"kendall": kendall_tau, "bicor": bicor, "xi": lambda d, a, b: xi_corr(d, a, b, seed)}[method](df, x, y)
