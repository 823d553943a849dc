"""Linear models from moments: one aggregation of cross products, then a solve of a few unknowns.

The moment row is mergeable, so any table size costs one pass; solving happens per group in a vectorised function, or on
the driver for one model.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import special
from ..core.prefix import in_blocks, running
from ..core.col import dbl, ieee_div, to_col, total

NAN = float("nan")


def lr_formula(s: str | Column) -> Column:
    """A string is an SQL expression that keeps its text as name."""
    return F.expr(s).alias(s) if isinstance(s, str) else s


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _name(x) -> str:
    return x if isinstance(x, str) else "x"


def prepare(df: DataFrame, features: list, target, by: list[str], null_policy: str = "skip", weights=None) -> DataFrame:
    """by, x0.., y, w as doubles under the null policy: raise, skip, ignore, zero, one, or a number to fill features with."""
    x = [(F.expr(f) if isinstance(f, str) else f).cast("double") for f in features]
    y = (F.expr(target) if isinstance(target, str) else target).cast("double")
    w = F.lit(1.0) if weights is None else (F.expr(weights) if isinstance(weights, str) else weights).cast("double")
    d = df.select(*by, *(c.alias(f"x{i}") for i, c in enumerate(x)), y.alias("y"), w.alias("w"))
    names = [f"x{i}" for i in range(len(x))]
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    if null_policy in ("zero", "one") or null_policy not in ("raise", "skip", "ignore"):
        fill = {"zero": 0.0, "one": 1.0}.get(null_policy)
        fill = float(null_policy) if fill is None else fill
        d = d.withColumns({n: F.when(bad(n), F.lit(fill)).otherwise(F.col(n)) for n in names}).filter(~bad("y"))
    elif null_policy == "skip":
        keep = ~bad("y")
        for n in names:
            keep = keep & ~bad(n)
        d = d.filter(keep)
    elif null_policy == "raise":
        test = bad("y")
        for n in names:
            test = test | bad(n)
        d = d.withColumn("y", F.when(test, F.raise_error(F.lit("nulls in the data"))).otherwise(F.col("y")))
    return d


def moment_columns(p: int, add_bias: bool) -> list[Column]:
    """The upper triangle of [X 1]'W[X 1], then [X 1]'Wy, y'Wy, the sum of weights and the count."""
    v = [F.col(f"x{i}") for i in range(p)] + ([F.lit(1.0)] if add_bias else [])
    w, y = F.col("w"), F.col("y")
    xx = [F.sum(v[i] * v[j] * w) for i in range(len(v)) for j in range(i, len(v))]
    return [F.array(*xx, *(F.sum(a * y * w) for a in v), F.sum(y * y * w), F.sum(w), F.count(F.lit(1)).cast("double"), F.sum(y * w)).alias("moments")]


def unpack(m, k: int) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """XtX, Xty, yty, sum of weights, sum of y."""
    m = np.asarray(m, float)
    a = np.zeros((k, k))
    t = k * (k + 1) // 2
    a[np.triu_indices(k)] = m[:t]
    a = a + np.triu(a, 1).T
    return a, m[t : t + k], float(m[t + k]), float(m[t + k + 1]), float(m[t + k + 3])


def singular(a: np.ndarray, tol: float) -> bool:
    """Whether columns are as good as dependent: log det(XtX) less the logs of its diagonal."""
    sign, logdet = np.linalg.slogdet(a)
    diag = np.diag(a)
    return bool(sign <= 0 or (diag <= 0).any() or logdet - np.log(diag).sum() <= math.log(tol))


def soft(x: float, t: float) -> float:
    return math.copysign(max(abs(x) - t, 0.0), x)


def solve(a: np.ndarray, b: np.ndarray, n: float, *, add_bias: bool, l1: float = 0.0, l2: float = 0.0, positive: bool = False, tol: float = 1e-5, max_iter: int = 200, singular_tol: float | None = None) -> np.ndarray | None:
    """Coefficients (bias last) of least squares, ridge, lasso, elastic net or non-negative least squares."""
    if singular_tol is not None and singular(a, singular_tol):
        return None
    k = len(b)
    if not l1 and not positive:
        reg = np.eye(k) * l2
        if add_bias:
            reg[-1, -1] = 0
        try:
            return np.linalg.solve(a + reg, b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(a + reg, b, rcond=None)[0]
    beta = np.zeros(k)
    p = k - add_bias
    for _ in range(max_iter):
        most = 0.0
        for j in range(k):
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            if j >= p:
                new = r / a[j, j]
            elif l1 or l2:
                new = soft(r, n * l1) / (a[j, j] + n * l2)
            else:
                new = r / a[j, j] if a[j, j] else 0.0
            if positive and j < p:
                new = max(new, 0.0)
            most = max(most, abs(new - beta[j]))
            beta[j] = new
        if most < tol:
            break
    return beta


def _solver(k: int, f):
    """A pandas UDF from the moments to an array; null where ``f`` gives None."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out = []
        for row in m:
            if row is None or any(v is None for v in row):
                out.append(None)
                continue
            a, b, yy, w, sy = unpack(row, k)
            got = f(a, b, yy, w, sy)
            out.append(None if got is None else [float(v) for v in got])
        return pd.Series(out)

    return run


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solutions of many systems; where one is singular, its least squares of least norm."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.linalg.lstsq(a[0], b[0], rcond=None)[0][None]
        half = len(a) // 2
        return np.concatenate([_solved(a[:half], b[:half]), _solved(a[half:], b[half:])])


def _window_solver(k: int, add_bias: bool, l2: float, least: int):
    """A pandas UDF from the moments of windows to coefficients, a batch at once; null below ``least`` rows."""
    t = k * (k + 1) // 2

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out = np.full(len(m), None, object)
        at = np.flatnonzero(m.notna().to_numpy())
        if len(at):
            rows = np.stack(m.to_numpy()[at]).astype(float)
            enough = rows[:, t + k + 1] >= least
            at, rows = at[enough], rows[enough]
        if len(at):
            i, j = np.triu_indices(k)
            a = np.zeros((len(at), k, k))
            a[:, i, j] = a[:, j, i] = rows[:, :t]
            diagonal = np.arange(k - 1 if add_bias else k)
            a[:, diagonal, diagonal] += l2
            for n, got in zip(at.tolist(), _solved(a, rows[:, t : t + k])):
                out[n] = got
        return pd.Series(out)

    return run


def lin_reg(df: DataFrame, *x, target, add_bias: bool = False, weights=None, l1_reg: float = 0.0, l2_reg: float = 0.0, tol: float = 1e-5, solver: str = "qr", max_iter: int = 200, null_policy: str = "skip", positive: bool = False, singular_x_tol: float | None = None, by=None) -> DataFrame:
    """Coefficients, bias last, for each group; for a list of targets one column a target.

    ``solver`` is accepted (qr, svd, cholesky, choleskey) and changes nothing: the moments are solved directly.
    """
    by = _by(by)
    targets = list(target) if isinstance(target, list | tuple) else [target]
    k = len(x) + add_bias
    run = _solver(k, lambda a, b, yy, w, sy: solve(a, b, w, add_bias=add_bias, l1=l1_reg, l2=l2_reg, positive=positive, tol=tol, max_iter=max_iter, singular_tol=singular_x_tol))
    out = None
    for i, t in enumerate(targets):
        name = "coeffs" if len(targets) == 1 else f"coeffs_{_name(t)}" if isinstance(t, str) else f"coeffs_{i}"
        one = prepare(df, list(x), t, by, null_policy, weights).groupBy(*by).agg(*moment_columns(len(x), add_bias)).select(*by, run("moments").alias(name))
        out = one if out is None else out.join(one, by) if by else out.crossJoin(one)  # one row each
    return out


def lin_reg_pred(df: DataFrame, *x, target, by=None, add_bias: bool = False, name: str = "pred", **options) -> DataFrame:
    """The frame with pred and resid of its group's model; rows with nulls in a feature get null."""
    by = _by(by)
    c = lin_reg(df, *x, target=target, add_bias=add_bias, by=by, **options)
    d = df.join(F.broadcast(c) if not by else c, by) if by else df.crossJoin(F.broadcast(c))  # one row without groups
    xs = [(F.expr(f) if isinstance(f, str) else f).cast("double") for f in x] + ([F.lit(1.0)] if add_bias else [])
    pred = total(F.get("coeffs", F.lit(i)) * v for i, v in enumerate(xs))
    y = (F.expr(target) if isinstance(target, str) else target).cast("double")
    return d.withColumn(name, pred).withColumn("resid", y - F.col(name)).drop("coeffs")


def simple_lin_reg(x, target, add_bias: bool = False, weights=None) -> Column:
    """One feature in closed form, as an aggregate: [slope] or [slope, intercept]."""
    x, y, w = dbl(x), dbl(target), F.lit(1.0) if weights is None else dbl(weights)
    ok = x.isNotNull() & y.isNotNull()
    x, y, w = (F.when(ok, c) for c in (x, y, w))
    if not add_bias:
        return F.array(ieee_div(F.sum(w * x * y), F.sum(w * x * x)))
    s, mx, my = F.sum(w), ieee_div(F.sum(w * x), F.sum(w)), ieee_div(F.sum(w * y), F.sum(w))
    slope = ieee_div(F.sum(w * x * y) - s * mx * my, F.sum(w * x * x) - s * mx * mx)
    return F.array(slope, my - slope * mx)


def lin_reg_w_rcond(df: DataFrame, *x, target, add_bias: bool = False, rcond: float = 0.0, l2_reg: float = 0.0, null_policy: str = "raise", by=None) -> DataFrame:
    """Coefficients without the directions whose singular value is below rcond times the greatest, and the singular values."""
    by = _by(by)
    k = len(x) + add_bias

    def f(a, b, yy, w, sy):
        reg = np.eye(k) * l2_reg
        if add_bias:
            reg[-1, -1] = 0
        values, vectors = np.linalg.eigh(a + reg)
        s = np.sqrt(np.maximum(values, 0))[::-1]
        keep = np.sqrt(np.maximum(values, 0)) >= rcond * s[0]
        keep &= values > 0
        return [*((vectors[:, keep] / values[keep]) @ (vectors[:, keep].T @ b)), *s]

    d = prepare(df, list(x), target, by, null_policy).groupBy(*by).agg(*moment_columns(len(x), add_bias)).select(*by, _solver(k, f)("moments").alias("r"))
    return d.select(*by, F.slice("r", 1, k).alias("coeffs"), F.slice("r", k + 1, k).alias("singular_values"))


def _windowed(df: DataFrame, x: tuple, target, order_by, before: int | None, add_bias: bool, l2_reg: float, least: int, by) -> DataFrame:
    """Coefficients and prediction of each row from the moments of it and the ``before`` rows before it (all rows, if None)."""
    by = _by(by)
    k = len(x) + add_bias
    xs = [(F.expr(f) if isinstance(f, str) else f).cast("double") for f in x] + ([F.lit(1.0)] if add_bias else [])
    y = (F.expr(target) if isinstance(target, str) else target).cast("double")
    ok = y.isNotNull()
    for v in xs:
        ok = ok & v.isNotNull()
    sums = [F.when(ok, xs[i] * xs[j]) for i in range(k) for j in range(i, k)] + [F.when(ok, v * y) for v in xs]
    if not by and before is None:
        # running sums of the whole frame
        names = [f"part_{i}_" for i in range(len(sums) + 1)]
        d = df.withColumns({**dict(zip(names, sums)), names[-1]: F.when(ok, 1.0)}).withColumn("order_", to_col(order_by[0] if isinstance(order_by, list) else order_by))
        upto = [f"upto_{i}_" for i in range(len(names))]
        d = running(d, "order_", dict(zip(upto, names)), ties=[to_col(o) for o in order_by[1:]] if isinstance(order_by, list) else None)
        m = F.array(*(F.col(c) for c in upto[:-1]), F.lit(0.0), F.col(upto[-1]), F.col(upto[-1]), F.lit(0.0))
        gone = ["moments_", "order_", *names, *upto]
    else:
        d, block, own = (df, None, None) if by else in_blocks(df, order_by if isinstance(order_by, list) else [order_by], before)
        w = Window.partitionBy(*(by or [block])).orderBy(*(order_by if isinstance(order_by, list) else [order_by])).rowsBetween(Window.unboundedPreceding if before is None else -before, 0)
        n = F.count(F.when(ok, 1)).over(w).cast("double")
        m = F.array(*(F.sum(c).over(w) for c in sums), F.lit(0.0), n, n, F.lit(0.0))
        gone = ["moments_", *([block, own] if block else [])]
    d = d.withColumn("moments_", m)
    if not by and before is not None:
        d = d.filter(own)
    run = _window_solver(k, add_bias, l2_reg, least)
    d = d.withColumn("coeffs", run("moments_")).drop(*gone)
    return d.withColumn("pred", total(F.get("coeffs", F.lit(i)) * v for i, v in enumerate(xs)))


def recursive_lin_reg(df: DataFrame, *x, target, start_with: int, order_by, add_bias: bool = False, l2_reg: float = 0.0, by=None) -> DataFrame:
    return _windowed(df, x, target, order_by, None, add_bias, l2_reg, start_with, by)


def rolling_lin_reg(df: DataFrame, *x, target, window_size: int, order_by, add_bias: bool = False, l2_reg: float = 0.0, min_valid_rows: int | None = None, by=None) -> DataFrame:
    return _windowed(df, x, target, order_by, window_size - 1, add_bias, l2_reg, min_valid_rows or window_size, by)


def lin_reg_report(df: DataFrame, *x, target, weights=None, add_bias: bool = False, null_policy: str = "raise", std_err: str = "se", by=None) -> DataFrame:
    """One row a feature: beta, std_err, t, p>|t|, 0.025, 0.975, r2, adj_r2.

    Plain errors come from the moments alone; hc0 to hc3 take a second pass for squared residuals over the leverages.
    """
    by = _by(by)
    p, k = len(x), len(x) + add_bias
    names = [f if isinstance(f, str) else f"x{i}" for i, f in enumerate(x)] + (["__bias__"] if add_bias else [])
    d = prepare(df, list(x), target, by, null_policy, weights)
    v = [F.col(f"x{i}") for i in range(p)] + ([F.lit(1.0)] if add_bias else [])
    base = d.groupBy(*by).agg(*moment_columns(p, add_bias))
    if std_err != "se":
        inv = _solver(k, lambda a, b, yy, w, sy: [*np.linalg.solve(a, b), *np.linalg.inv(a).ravel()])
        solved = base.select(*by, "moments", inv("moments").alias("s_"))
        e = d.join(solved, by) if by else d.crossJoin(F.broadcast(solved))  # one row
        s = lambda i: F.get("s_", F.lit(i))
        resid = F.col("y") - total(s(i) * v[i] for i in range(k))
        lev = total(v[i] * v[j] * s(k + i * k + j) for i in range(k) for j in range(k)) * F.col("w")
        n = F.get("moments", F.lit(k * (k + 1) // 2 + k + 2))
        scale = {"hc0": F.lit(1.0), "hc1": n / (n - k), "hc2": 1 / (1 - lev), "hc3": 1 / ((1 - lev) * (1 - lev))}[std_err]
        e = e.withColumn("e2_", resid * resid * scale * F.col("w") * F.col("w"))
        meat = e.groupBy(*by, "moments").agg(F.array(*(F.sum(v[i] * v[j] * F.col("e2_")) for i in range(k) for j in range(k))).alias("meat"))
        base = meat.select(*by, F.concat("moments", "meat").alias("moments"))

    def f(a, b, yy, w, sy, meat=None, n=None):
        inv = np.linalg.pinv(a) if singular(a, 1e-14) else np.linalg.inv(a)
        beta = inv @ b
        rss = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
        dof = n - k
        tss = yy - sy * sy / w if add_bias else yy
        r2 = 1 - rss / tss if tss else NAN
        adj = 1 - (1 - r2) * (n - add_bias) / dof if dof else NAN
        cov = inv @ meat @ inv if meat is not None else inv * (rss / dof if dof else NAN)
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        q = special.t_ppf(0.975, dof) if dof > 0 else NAN
        out = []
        for bj, sj in zip(beta, se):
            t = bj / sj if sj else NAN
            out += [bj, sj, t, 2 * special.t_sf(abs(t), dof) if t == t else NAN, bj - q * sj, bj + q * sj, r2, adj]
        return out

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out, t = [], k * (k + 1) // 2 + k + 4
        for row in m:
            row = np.asarray(row, float)
            a, b, yy, w, sy = unpack(row, k)
            out.append([float(z) for z in f(a, b, yy, w, sy, row[t:].reshape(k, k) if len(row) > t else None, row[t - 2])])
        return pd.Series(out)

    r = base.select(*by, run("moments").alias("r"))
    fields = ("beta", "std_err", "t", "p>|t|", "0.025", "0.975", "r2", "adj_r2")
    rows = F.array(*(F.struct(F.lit(n).alias("features"), *(F.get("r", F.lit(8 * i + j)).alias(c) for j, c in enumerate(fields))) for i, n in enumerate(names)))
    return r.select(*by, F.inline(rows))


# --- iterative models: each step is one aggregation of the same moments under new weights


def _irls(d: DataFrame, p: int, add_bias: bool, family: str, max_iter: int, tol: float, l2: float = 0.0) -> np.ndarray:
    """Iteratively reweighted least squares with the canonical link."""
    k = p + add_bias
    v = [F.col(f"x{i}") for i in range(p)] + ([F.lit(1.0)] if add_bias else [])
    y = F.col("y")
    mean = d.agg(F.avg("y")).first()[0]
    if mean is None:
        return np.full(k, NAN)
    beta = None
    for _ in range(max_iter):
        mu = (y + 0.5) / 2 if family == "binomial" and beta is None else (y + mean) / 2 if beta is None else None
        if mu is None:
            eta = total(float(b) * c for b, c in zip(beta, v))
            mu = {"gaussian": eta, "poisson": F.exp(eta), "binomial": 1 / (1 + F.exp(-eta)), "gamma": ieee_div(1.0, eta)}[family]
        else:
            eta = {"gaussian": mu, "poisson": F.log(mu), "binomial": F.log(mu / (1 - mu)), "gamma": 1 / mu}[family]
        w = {"gaussian": F.lit(1.0), "poisson": mu, "binomial": mu * (1 - mu), "gamma": mu * mu}[family]
        slope = {"gaussian": F.lit(1.0), "poisson": 1 / mu, "binomial": ieee_div(1.0, mu * (1 - mu)), "gamma": -1 / (mu * mu)}[family]
        z = eta + (y - mu) * slope
        row = d.select(*(f"x{i}" for i in range(p)), z.alias("y"), (w * F.col("w")).alias("w")).agg(*moment_columns(p, add_bias)).first()
        a, b, *_ = unpack(row.moments, k)
        new = solve(a, b, 1.0, add_bias=add_bias, l2=l2)
        if beta is not None and np.abs(new - beta).max() < tol:
            return new
        beta = new
    return beta


def logistic_reg(df: DataFrame, *x, target, add_bias: bool = True, l1_reg: float = 0.0, l2_reg: float = 0.0, tol: float = 1e-8, max_iter: int = 200, null_policy: str = "skip") -> np.ndarray:
    """Coefficients, bias last, of the mean log loss plus l2/2 |w|^2 plus l1 |w|_1: reweighted least squares, with l1 by coordinate descent on each step's moments."""
    d = prepare(df, list(x), target, [], null_policy).cache()
    p, k = len(x), len(x) + add_bias
    v = [F.col(f"x{i}") for i in range(p)] + ([F.lit(1.0)] if add_bias else [])
    beta = np.zeros(k)
    try:
        for _ in range(max_iter):
            eta = total(float(b) * c for b, c in zip(beta, v))
            mu = 1 / (1 + F.exp(-eta))
            w = F.greatest(mu * (1 - mu), F.lit(1e-10))
            z = eta + (F.col("y") - mu) / w
            row = d.select(*(f"x{i}" for i in range(p)), z.alias("y"), w.alias("w")).agg(*moment_columns(p, add_bias)).first()
            a, b, *_ = unpack(row.moments, k)
            n = row.moments[-2]
            # the penalties are on the mean loss, the moments are sums
            new = solve(a / n, b / n, 1.0, add_bias=add_bias, l1=l1_reg, l2=l2_reg, tol=tol / 10, max_iter=2000)
            if np.abs(new - beta).max() < tol:
                return new
            beta = new
        return beta
    finally:
        d.unpersist()


class _Model:
    """Coefficients and bias, and a prediction as a Catalyst expression."""

    def __init__(self, has_bias: bool = False) -> None:
        self.has_bias, self._coeffs, self._bias, self.feature_names_in_ = has_bias, None, 0.0, None

    def is_fit(self) -> bool:
        return self._coeffs is not None

    def coeffs(self) -> np.ndarray:
        return self._coeffs

    def bias(self) -> float:
        return self._bias

    def set_input_features(self, names: list[str]):
        self.feature_names_in_ = list(names)
        return self

    def _take(self, beta: np.ndarray):
        self._coeffs, self._bias = (beta[:-1], float(beta[-1])) if self.has_bias else (beta, 0.0)
        return self

    def predict(self, X) -> np.ndarray:
        return np.asarray(X, float) @ self._coeffs + self._bias

    def linear(self) -> Column:
        return total([*(float(b) * dbl(f) for b, f in zip(self._coeffs, self.feature_names_in_)), F.lit(self._bias)])

    def predict_df(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.linear())

    def __repr__(self) -> str:
        return f"{type(self).__name__}(coeffs={self._coeffs}, bias={self._bias})"


def _arrays(X, y, null_policy: str) -> tuple[np.ndarray, np.ndarray]:
    X, y = np.asarray(X, float), np.asarray(y, float).ravel()
    X = X[:, None] if X.ndim == 1 else X
    if null_policy in ("zero", "one"):
        X = np.where(np.isnan(X), float(null_policy == "one"), X)
    if null_policy in ("skip", "zero", "one"):
        keep = ~np.isnan(y) & ~np.isnan(X).any(axis=1)
        X, y = X[keep], y[keep]
    if null_policy == "raise" and (np.isnan(X).any() or np.isnan(y).any()):
        raise ValueError("nulls in the data")
    return X, y


class LR(_Model):
    """Least squares and ridge."""

    def __init__(self, has_bias: bool = False, lambda_: float = 0.0, solver: str = "qr") -> None:
        super().__init__(has_bias)
        self.lambda_, self.solver = lambda_, solver

    _l1, _l2 = 0.0, property(lambda self: self.lambda_)

    @classmethod
    def from_values(cls, coeffs, bias: float = 0.0, feature_names_in_=None):
        m = cls(has_bias=bool(bias))
        m._coeffs, m._bias, m.feature_names_in_ = np.asarray(coeffs, float), float(bias), feature_names_in_
        return m

    def _solve(self, a, b, n):
        return self._take(solve(a, b, n, add_bias=self.has_bias, l1=self._l1, l2=self._l2, tol=getattr(self, "tol", 1e-5), max_iter=getattr(self, "max_iter", 200)))

    def fit(self, X, y, null_policy: str = "ignore"):
        X, y = _arrays(X, y, null_policy)
        X = np.column_stack([X, np.ones(len(X))]) if self.has_bias else X
        return self._solve(X.T @ X, X.T @ y, float(len(y)))

    def fit_df(self, df: DataFrame, features: list[str], target: str, null_policy: str = "skip", show_report: bool = False):
        row = prepare(df, features, target, [], null_policy).agg(*moment_columns(len(features), self.has_bias)).first()
        a, b, _, n, _ = unpack(row.moments, len(features) + self.has_bias)
        self.feature_names_in_ = list(features)
        if show_report:
            lin_reg_report(df, *features, target=target, add_bias=self.has_bias, null_policy=null_policy).show()
        return self._solve(a, b, n)


class ElasticNet(LR):
    def __init__(self, l1_reg: float, l2_reg: float, has_bias: bool = False, tol: float = 1e-5, max_iter: int = 2000) -> None:
        super().__init__(has_bias)
        self.l1_reg, self.l2_reg, self.tol, self.max_iter = l1_reg, l2_reg, tol, max_iter

    _l1, _l2 = property(lambda self: self.l1_reg), property(lambda self: self.l2_reg)

    @classmethod
    def from_values(cls, coeffs, bias: float = 0.0, feature_names_in_=None):
        m = cls(0.0, 0.0, has_bias=bool(bias))
        m._coeffs, m._bias, m.feature_names_in_ = np.asarray(coeffs, float), float(bias), feature_names_in_
        return m


class OnlineLR(_Model):
    """Least squares that takes rows in and out: it holds (XtX)^-1 and Xty."""

    def __init__(self, has_bias: bool = False, lambda_: float = 0.0) -> None:
        super().__init__(has_bias)
        self.lambda_, self._a, self._b = lambda_, None, None

    @classmethod
    def from_coeffs_bias_inverse(cls, coeffs, bias: float, inv):
        m = cls(has_bias=bool(bias))
        m._a = np.linalg.inv(np.asarray(inv, float))
        beta = np.append(coeffs, bias) if bias else np.asarray(coeffs, float)
        m._b = m._a @ beta
        return m._take(beta)

    def inv(self) -> np.ndarray:
        return np.linalg.inv(self._a)

    def state(self) -> tuple[list[float], list[float]] | None:
        """XtX (with the penalty) and Xty, to be saved; None before the first rows."""
        return None if self._a is None else (self._a.ravel().tolist(), self._b.tolist())

    def restore(self, a: list[float], b: list[float]):
        self._a, self._b = np.array(a).reshape(len(b), len(b)), np.array(b)
        return self._take(np.linalg.solve(self._a, self._b))

    def _merge(self, a: np.ndarray, b: np.ndarray):
        if self._a is None:
            reg = np.eye(len(b)) * self.lambda_
            if self.has_bias:
                reg[-1, -1] = 0
            self._a, self._b = reg, np.zeros(len(b))
        self._a, self._b = self._a + a, self._b + b
        return self._take(np.linalg.solve(self._a, self._b))

    def fit(self, X, y):
        self._a = None
        return self.update(X, y)

    def update(self, X, y, c: float = 1.0):
        """Adds (c = 1) or removes (c = -1) rows."""
        X = np.atleast_2d(np.asarray(X, float))
        X = np.column_stack([X, np.ones(len(X))]) if self.has_bias else X
        return self._merge(c * X.T @ X, c * X.T @ np.asarray(y, float).ravel())

    def update_df(self, df: DataFrame, features: list[str], target: str, c: float = 1.0):
        """The same from a frame's moments: fit for foreachBatch."""
        row = prepare(df, features, target, [], "skip").agg(*moment_columns(len(features), self.has_bias)).first()
        if row.moments[0] is None:
            return self
        a, b, *_ = unpack(row.moments, len(features) + self.has_bias)
        self.feature_names_in_ = list(features)
        return self._merge(c * a, c * b)


class GLM(_Model):
    def __init__(self, family: str = "gaussian", has_bias: bool = True, max_iter: int = 100, tol: float = 1e-8) -> None:
        super().__init__(has_bias)
        self.family, self.max_iter, self.tol = family, max_iter, tol

    def fit_df(self, df: DataFrame, features: list[str], target: str, null_policy: str = "skip", show_report: bool = False):
        self.feature_names_in_ = list(features)
        d = prepare(df, features, target, [], null_policy).cache()
        try:
            self._take(_irls(d, len(features), self.has_bias, self.family, self.max_iter, self.tol))
        finally:
            d.unpersist()
        if show_report:
            self.report(df).show()
        return self

    def fit(self, X, y, null_policy: str = "ignore"):
        """From arrays, which fit the driver: they become a frame."""
        X, y = _arrays(X, y, null_policy)
        names = [f"x{i}" for i in range(X.shape[1])]
        spark = SparkSession.active()
        return self.fit_df(spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(X, y)], ", ".join(f"{n} double" for n in [*names, "y"])), names, "y")

    def report(self, df: DataFrame) -> DataFrame:
        """(feature, beta) of the fitted model."""
        names = [*self.feature_names_in_, *(["__bias__"] if self.has_bias else [])]
        betas = [*np.asarray(self._coeffs, float), *([float(self._bias)] if self.has_bias else [])]
        return df.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(names, betas)], "feature string, beta double")

    def mean(self) -> Column:
        eta = self.linear()
        return {"gaussian": eta, "poisson": F.exp(eta), "binomial": 1 / (1 + F.exp(-eta)), "gamma": ieee_div(1.0, eta)}[self.family]

    def predict_df(self, df: DataFrame, name: str = "prediction", linear: bool = False) -> DataFrame:
        return df.withColumn(name, self.linear() if linear else self.mean())

    def predict(self, X, linear: bool = False) -> np.ndarray:
        eta = super().predict(X)
        return eta if linear else {"gaussian": eta, "poisson": np.exp(eta), "binomial": 1 / (1 + np.exp(-eta)), "gamma": 1 / eta}[self.family]


class MixedModel:
    """Random intercepts by REML: per-group sums, then a golden-section search of the variance ratio on the driver."""

    def fit_df(self, df: DataFrame, features: list[str], target: str, group: str, null_policy: str = "skip", max_iter: int = 200, tol: float = 1e-10):
        p, k = len(features), len(features) + 1
        d = prepare(df, features, target, [group], null_policy)
        v = [F.col(f"x{i}") for i in range(p)] + [F.lit(1.0)]
        # groups enter by size, sums of features and target: their squares are summed for each size, so the driver gets one row a size
        g = d.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(v)), F.sum("y").alias("sy"))
        s = [F.col(f"s{i}") for i in range(k)]
        sizes = g.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.array(*(F.sum(s[i] * s[j]) for i in range(k) for j in range(k)), *(F.sum(s[i] * F.col("sy")) for i in range(k)), F.sum(F.col("sy") * F.col("sy"))).alias("q")).collect()
        row = d.agg(*moment_columns(p, True)).first()
        a, b, yy, n, _ = unpack(row.moments, k)
        n_groups = sum(r.m for r in sizes)
        q = [(r.n, r.m, np.array(r.q)) for r in sizes]

        def at(ratio: float):
            A, B, Y, logdet = a.copy(), b.copy(), yy, 0.0
            for size, m, x in q:
                c = ratio / (1 + ratio * size)
                A -= c * x[: k * k].reshape(k, k)
                B -= c * x[k * k : k * k + k]
                Y -= c * x[-1]
                logdet += m * math.log1p(ratio * size)
            beta = np.linalg.solve(A, B)
            rss = Y - beta @ B
            s2 = rss / (n - k)
            return (n - k) * math.log(max(s2, 1e-300)) + logdet + np.linalg.slogdet(A)[1], beta, s2, A

        lo, hi, g_ = -30.0, math.log(1e6), (math.sqrt(5) - 1) / 2
        c, e = hi - g_ * (hi - lo), lo + g_ * (hi - lo)
        fc, fe = at(math.exp(c))[0], at(math.exp(e))[0]
        for _ in range(max_iter):
            if hi - lo < tol:
                break
            if fc < fe:
                hi, e, fe = e, c, fc
                c = hi - g_ * (hi - lo)
                fc = at(math.exp(c))[0]
            else:
                lo, c, fc = c, e, fe
                e = lo + g_ * (hi - lo)
                fe = at(math.exp(e))[0]
        ratio = math.exp((lo + hi) / 2)
        ratio = 0.0 if at(0.0)[0] <= at(ratio)[0] else ratio
        _, beta, s2, A = at(ratio)
        self.names_ = [*features, "__bias__"]
        self.coeffs_, self.resid_variance_, self.gamma_ = beta, s2, ratio * s2
        self.std_errors_ = np.sqrt(np.diag(np.linalg.inv(A)) * s2)
        # a feature that is constant in every group (and the intercept) is tested against the groups, the others against the rows
        spread = d.groupBy(group).agg(*(F.max(f"x{i}").alias(f"a{i}") for i in range(p)), *(F.min(f"x{i}").alias(f"b{i}") for i in range(p))).agg(*(F.bool_and(F.col(f"a{i}") == F.col(f"b{i}")).alias(f"c{i}") for i in range(p))).first()
        between = np.array([*spread, True], bool)
        within = a - sum(x[: k * k].reshape(k, k) / size for size, _, x in q)
        rank = lambda m: int((np.linalg.eigvalsh(m / max(np.abs(m).max(), 1e-300)) > 1e-9).sum()) if m.size else 0
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        unit = lambda m, at: rank((m / np.outer(scale, scale))[np.ix_(at, at)])
        inside = unit(within, ~between) if (~between).any() else 0
        self.dfs_ = np.where(between, n_groups - unit(a, between), n - n_groups - inside).astype(float)
        return self

    def report(self) -> list[dict]:
        """A row for each fixed effect, the intercept first."""
        order = [len(self.names_) - 1, *range(len(self.names_) - 1)]
        out = []
        for j in order:
            b, s, df = float(self.coeffs_[j]), float(self.std_errors_[j]), float(self.dfs_[j])
            out.append({"effect": "Intercept" if self.names_[j] == "__bias__" else self.names_[j], "estimate": b, "std_err": s, "df": df, "t": b / s, "p_value": 2 * special.t_sf(abs(b / s), df)})
        return out


def query_ar_coeffs(df: DataFrame, x: str, lag: int, order_by, add_bias: bool = True, by=None) -> DataFrame:
    """Least squares of x on its own lags; the first rows, which have none, are left out."""
    by = _by(by)
    order = order_by if isinstance(order_by, list) else [order_by]
    d, block, own = (df, None, None) if by else in_blocks(df, order, lag)
    w = Window.partitionBy(*(by or [block])).orderBy(*order)
    lags = {f"lag_{i}": F.lag(dbl(x), i).over(w) for i in range(1, lag + 1)}
    d = d.withColumns(lags)
    return lin_reg(d if by else d.filter(own), *lags, target=x, add_bias=add_bias, by=by)


# --- decomposition, from the same moments


def _cross(df: DataFrame, features: list, center: bool) -> tuple[np.ndarray, np.ndarray, float]:
    p = len(features)
    d = prepare(df, features, F.lit(0.0), [], "skip")
    row = d.agg(*moment_columns(p, True)).first()
    if row.moments[0] is None:
        return np.full((p, p), NAN), np.zeros(p), 0.0
    a, *_ = unpack(row.moments, p + 1)
    n, s = a[-1, -1], a[:-1, -1]
    return (a[:-1, :-1] - np.outer(s, s) / n if center else a[:-1, :-1]), s / n, n


def _eig(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(a)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    for j in range(vectors.shape[1]):  # the entry of greatest size is positive
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] *= -1
    return np.sqrt(values), vectors


def singular_values(df: DataFrame, *features, center: bool = True, as_explained_var: bool = False, as_ratio: bool = False) -> list[float]:
    a, _, n = _cross(df, list(features), center)
    s, _ = _eig(a)
    v = s * s / max(n - 1, 1) if as_explained_var else s
    return (v / v.sum() if as_ratio else v).tolist()


def pca(df: DataFrame, *features, center: bool = True) -> DataFrame:
    """(singular_value, weight_vector), greatest first."""
    a, _, _ = _cross(df, list(features), center)
    s, v = _eig(a)
    return df.sparkSession.createDataFrame([(float(x), v[:, j].tolist()) for j, x in enumerate(s)], "singular_value double, weight_vector array<double>")


def principal_components(df: DataFrame, *features, k: int = 2, center: bool = True) -> DataFrame:
    """The frame with pc1 to pck: linear expressions with the loadings as literals."""
    a, mean, n = _cross(df, list(features), center)
    if n < k:
        return df.withColumns({f"pc{j + 1}": F.lit(NAN) for j in range(k)})
    _, v = _eig(a)
    x = [(F.expr(f) if isinstance(f, str) else f).cast("double") for f in features]
    return df.withColumns({f"pc{j + 1}": total((c - (float(m) if center else 0.0)) * float(w) for c, m, w in zip(x, mean, v[:, j])) for j in range(k)})


__all__ = ["lr_formula", "lin_reg", "lin_reg_pred", "simple_lin_reg", "lin_reg_w_rcond", "recursive_lin_reg", "rolling_lin_reg", "lin_reg_report", "logistic_reg", "LR", "ElasticNet", "OnlineLR", "GLM", "MixedModel", "query_ar_coeffs", "singular_values", "pca", "principal_components", "to_col"]
