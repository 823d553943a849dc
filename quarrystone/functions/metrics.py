"""Metrics of predictions.  One-pass metrics are aggregate Columns; those over ranked or grouped scores take a frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.prefix import running, series, with_totals
from ..core.col import INF, NAN, dbl, ieee_div, ieee_sqrt, quantile, to_col
from .num import xlogy


def _norm(x: Column, normalize: bool) -> Column:
    return F.avg(x) if normalize else F.sum(x)


def query_r2(actual, pred) -> Column:
    a, p = dbl(actual), dbl(pred)
    return 1 - ieee_div(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))


def query_adj_r2(actual, pred, p: int) -> Column:
    n = F.count(to_col(actual))
    return 1 - ieee_div((1 - query_r2(actual, pred)) * (n - 1), n - p)


def query_log_cosh(actual, pred, normalize: bool = True) -> Column:
    return _norm(F.log(F.cosh(dbl(pred) - dbl(actual))), normalize)


def query_hubor_loss(actual, pred, delta: float) -> Column:
    d = F.abs(dbl(actual) - dbl(pred))
    return F.avg(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)))


def query_l2(actual, pred, normalize: bool = True) -> Column:
    d = dbl(actual) - dbl(pred)
    return _norm(d * d, normalize)


def query_l1(actual, pred, normalize: bool = True) -> Column:
    return _norm(F.abs(dbl(actual) - dbl(pred)), normalize)


def query_l_inf(actual, pred) -> Column:
    return F.max(F.abs(dbl(actual) - dbl(pred)))


def query_log_loss(actual, pred, normalize: bool = True) -> Column:
    a, p = dbl(actual), dbl(pred)
    return -_norm(xlogy(a, p) + xlogy(1 - a, 1 - p), normalize)


def query_mape(actual, pred, weighted: bool = False) -> Column:
    a, p = dbl(actual), dbl(pred)
    return ieee_div(F.sum(F.abs(a - p)), F.sum(F.abs(a))) if weighted else F.avg(ieee_div(F.abs(a - p), F.abs(a)))


def query_smape(actual, pred) -> Column:
    a, p = dbl(actual), dbl(pred)
    return F.avg(ieee_div(F.abs(a - p), F.abs(a) + F.abs(p)))


def query_msle(actual, pred, normalize: bool = True) -> Column:
    d = F.log1p(dbl(actual)) - F.log1p(dbl(pred))
    return _norm(d * d, normalize)


def query_cat_cross_entropy(actual, pred, normalize: bool = True, dense: bool = True) -> Column:
    """``pred``: an array of probabilities; ``actual``: the class number (dense) or a one-hot array."""
    at = to_col(actual).cast("int") if dense else (F.array_position(to_col(actual), 1) - 1).cast("int")
    return _norm(-F.log(F.get(to_col(pred), at).cast("double")), normalize)


_RATES = "tpr tnr ppv npv fnr fpr fdr for lr+ lr- pt ts ba f1 mcc fm informedness markedness dor acc prevalence"


def query_confusion_matrix(actual, pred, threshold: float = 0.5, all_metrics: bool = False) -> Column:
    """A struct of tn, fp, fn, tp, or of those and the rates that follow; positive: pred above the threshold."""
    a, p = to_col(actual).cast("int") == 1, dbl(pred) > threshold
    c = {n: F.count_if(t).cast("double") for n, t in (("tn", ~a & ~p), ("fp", ~a & p), ("fn", a & ~p), ("tp", a & p))}
    out = [x.alias(n) for n, x in c.items()]
    if all_metrics:
        tn, fp, fn, tp = c.values()
        d = ieee_div
        tpr, tnr, ppv, npv = d(tp, tp + fn), d(tn, tn + fp), d(tp, tp + fp), d(tn, tn + fn)
        fnr, fpr, fdr, fo = d(fn, tp + fn), d(fp, tn + fp), d(fp, tp + fp), d(fn, tn + fn)
        mcc = d(tp * tn - fp * fn, ieee_sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        values = [tpr, tnr, ppv, npv, fnr, fpr, fdr, fo, d(tpr, fpr), d(fnr, tnr), d(ieee_sqrt(tpr * fpr) - fpr, tpr - fpr), d(tp, tp + fn + fp), (tpr + tnr) / 2, d(2 * tp, 2 * tp + fp + fn), mcc, ieee_sqrt(ppv * tpr), tpr + tnr - 1, ppv + npv - 1, d(d(tpr, fpr), d(fnr, tnr)), d(tp + tn, tp + tn + fp + fn), d(tp + fn, tp + tn + fp + fn)]
        out += [v.alias(n) for n, v in zip(_RATES.split(), values)]
    return F.struct(*out)


def query_mcc(y_true, y_pred) -> Column:
    a, p = to_col(y_true).cast("int") == 1, to_col(y_pred).cast("int") == 1
    tn, fp, fn, tp = (F.count_if(t).cast("double") for t in (~a & ~p, ~a & p, a & ~p, a & p))
    return ieee_div(tp * tn - fp * fn, ieee_sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


# --- frame-level: several stages


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def query_mad(df: DataFrame, x, use_mean: bool = True, by=None) -> DataFrame:
    """Mean (or median) absolute deviation from the mean (or median)."""
    by = _by(by)
    mid = F.avg(dbl(x)) if use_mean else quantile(x, 0.5)
    mids = df.groupBy(*by).agg(mid.alias("mid"))
    out = df.join(mids, by) if by else df.crossJoin(F.broadcast(mids))  # one row: the side is a single statistic
    d = F.abs(dbl(x) - F.col("mid"))
    return out.groupBy(*by).agg((F.avg(d) if use_mean else quantile(d, 0.5)).alias("mad"))


def _curve(df: DataFrame, actual, pred, by: list[str]) -> DataFrame:
    """For each distinct score: positives and rows with at least that score, and the totals."""
    counts = df.select(*by, to_col(actual).cast("int").alias("a"), dbl(pred).alias("score")).filter("a IS NOT NULL AND score IS NOT NULL").groupBy(*by, "score").agg(F.sum("a").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    run = running(counts, "score", {"tp": "p", "at_least": "n"}, by, descending=True)
    return with_totals(run, {"all_p": "p", "all_n": "n"}, by)


def query_roc_auc(df: DataFrame, actual, pred, by=None) -> DataFrame:
    """Area under the ROC curve, equal scores as one step; NaN without positives or negatives.  Scores are summed up per distinct value first."""
    by = _by(by)
    c = _curve(df, actual, pred, by)
    # a step of n - p negatives at true positives from tp - p to tp
    area = F.sum((F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2)
    all_p = F.max("all_p")
    return c.groupBy(*by).agg(ieee_div(area, all_p * (F.max("all_n") - all_p)).alias("roc_auc"))


def query_gini(df: DataFrame, actual, pred, by=None) -> DataFrame:
    return query_roc_auc(df, actual, pred, by).withColumn("gini", 2 * F.col("roc_auc") - 1).drop("roc_auc")


def query_tpr_fpr(df: DataFrame, actual, pred, by=None) -> DataFrame:
    """(threshold, tpr, fpr) for each distinct score and for infinity."""
    by = _by(by)
    c = _curve(df, actual, pred, by)
    rows = c.select(*by, F.col("score").alias("threshold"), ieee_div("tp", "all_p").alias("tpr"), ieee_div(F.col("at_least") - F.col("tp"), F.col("all_n") - F.col("all_p")).alias("fpr"))
    top = c.groupBy(*by).agg(F.lit(INF).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")) if by else c.agg(F.lit(INF).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return rows.unionByName(top)


def query_binary_metrics(df: DataFrame, actual, pred, threshold: float = 0.5, by=None) -> DataFrame:
    """precision, recall, f, average_precision, roc_auc; positive: a score of at least the threshold."""
    by = _by(by)
    c = _curve(df, actual, pred, by)
    hit = F.col("score") >= threshold
    tp, n, all_p = F.sum(F.when(hit, F.col("p")).otherwise(0.0)), F.sum(F.when(hit, F.col("n")).otherwise(0.0)), F.max("all_p")
    precision, recall = ieee_div(tp, n), ieee_div(tp, all_p)
    area = ieee_div(F.sum((F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2), all_p * (F.max("all_n") - all_p))
    ap = F.sum(ieee_div("p", "all_p") * ieee_div("tp", "at_least"))
    return c.groupBy(*by).agg(precision.alias("precision"), recall.alias("recall"), ieee_div(2 * precision * recall, precision + recall).alias("f"), ap.alias("average_precision"), area.alias("roc_auc"))


def query_multi_roc_auc(df: DataFrame, actual, pred, n_classes: int, strategy: str = "weighted", by=None) -> DataFrame:
    """One class against the rest on an array of probabilities; macro: plain mean, weighted: by class frequency."""
    by = _by(by)
    long = df.select(*by, to_col(actual).cast("int").alias("a"), F.posexplode(F.slice(to_col(pred), 1, n_classes)).alias("class", "score")).withColumn("is", (F.col("a") == F.col("class")).cast("int"))
    each = query_roc_auc(long, "is", "score", [*by, "class"]).join(long.groupBy(*by, "class").agg(F.sum("is").alias("w")), [*by, "class"])
    out = F.avg("roc_auc") if strategy == "macro" else ieee_div(F.sum(F.col("roc_auc") * F.col("w")), F.sum("w"))
    return each.groupBy(*by).agg(out.alias("roc_auc"))


def query_mase(df: DataFrame, actual, pred, train: str, order_by, freq: int = 1, use_mean: bool = True, by=None) -> DataFrame:
    """Absolute error over that of the seasonal naive forecast of the column ``train``."""
    by = _by(by)
    d, w, own = series(df, by, order_by, back=freq)
    step = F.abs(dbl(train) - F.lag(dbl(train), freq).over(w))
    pick = F.avg if use_mean else (lambda c: quantile(c, 0.5))
    return d.withColumn("naive", step).filter(own).groupBy(*by).agg(ieee_div(pick(F.abs(dbl(actual) - dbl(pred))), pick(F.col("naive"))).alias("mase"))


#: Ranks whose discounts are added up one by one; further ones go by the integral, with corrections below the last bit.
FIRST_RANKS = 4096


def discounts(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of 1 / ln(i + 1) over the ranks i from begin + 1 to end."""
    begin, end = np.asarray(begin, float), np.asarray(end, float)
    upto = np.append(0.0, np.cumsum(1 / np.log(np.arange(1, FIRST_RANKS + 1) + 1.0)))
    low = upto[np.minimum(end, FIRST_RANKS).astype(int)] - upto[np.minimum(begin, FIRST_RANKS).astype(int)]
    a, b = np.maximum(begin, FIRST_RANKS), np.maximum(end, FIRST_RANKS)
    out, many = low.copy(), np.flatnonzero(b - a > 32)
    few = np.flatnonzero((b > a) & (b - a <= 32))
    if len(few):
        i = a[few, None] + np.arange(1, 33)
        out[few] += np.where(i <= b[few, None], 1 / np.log(i + 1), 0.0).sum(axis=1)
    if len(many):
        # Euler and Maclaurin: the integral over ln(x + 1), in pieces of ln 2 at most, and what its ends leave over
        a, b = a[many], b[many]
        lo, hi = np.log(a + 2), np.log(b + 1)
        nodes, weights = np.polynomial.legendre.leggauss(20)
        pieces = int(np.ceil((hi - lo).max() / math.log(2))) or 1
        total = np.zeros(len(a))
        for p in range(pieces):
            h = (hi - lo) / (2 * pieces)
            u = lo[:, None] + h[:, None] * (2 * p + 1 + nodes)
            total += h * ((np.exp(u) / u) * weights).sum(axis=1)
        f = lambda u: 1 / u
        df = lambda u: -np.exp(-u) / u**2
        d3f = lambda u: -np.exp(-3 * u) * (2 / u**2 + 6 / u**3 + 6 / u**4)
        out[many] += total + (f(lo) + f(hi)) / 2 + (df(hi) - df(lo)) / 12 - (d3f(hi) - d3f(lo)) / 720
    return out


def _discounted(df: DataFrame, y: str, score: str, log_base: float, k: int | None, ignore_ties: bool, by: list[str], name: str) -> DataFrame:
    """Rows of equal score (and gain, where ties are ignored) are one: they hold a run of ranks, whose discounts are summed in closed form."""

    @F.pandas_udf("double")
    def summed(begin: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series(discounts(begin.to_numpy(), end.to_numpy()))

    slim = df.select(*by, dbl(y).alias("y"), F.coalesce(dbl(score), F.lit(-INF)).alias("s"))
    ties = slim.groupBy(*by, "s", *(["y"] if ignore_ties else [])).agg(F.sum("y").alias("y_"), F.count("y").alias("gains_"), F.count(F.lit(1)).alias("n_"))
    ranked = running(ties, "s", {"end_": "n_"}, by, descending=True, ties=[F.desc("y")] if ignore_ties else None)
    begin, end = F.col("end_") - F.col("n_"), F.col("end_")
    if k:
        begin, end = F.least(begin, F.lit(k)), F.least(end, F.lit(k))
    w = math.log(log_base) * F.when((F.col("n_") == 1) & (begin < end), 1 / F.log(end + 1.0)).when(begin < end, summed(begin, end)).otherwise(0.0)
    return ranked.groupBy(*by).agg(F.sum(ieee_div("y_", "gains_") * w).alias(name))


def query_dcg_score(df: DataFrame, y_true, y_score, log_base: float = 2.0, k: int | None = None, ignore_ties: bool = False, by=None) -> DataFrame:
    return _discounted(df, y_true, y_score, log_base, k, ignore_ties, _by(by), "dcg")


def query_ndcg_score(df: DataFrame, y_true, y_score, k: int | None = None, ignore_ties: bool = False, by=None) -> DataFrame:
    by = _by(by)
    got, best = _discounted(df, y_true, y_score, 2.0, k, ignore_ties, by, "dcg"), _discounted(df, y_true, y_true, 2.0, k, True, by, "ideal")
    both = got.join(best, by) if by else got.crossJoin(best)  # one row each
    share = ieee_div("dcg", "ideal")
    return both.select(*by, F.when(F.isnan(share), 0.0).otherwise(share).alias("ndcg"))


__all__ = [n for n in dir() if n.startswith("query_")] + ["NAN"]
