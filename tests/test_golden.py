"""Golden values of single operators, and numpy re-implementations of kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.core import special
from quarrystone.functions import metrics, num, stats, strings, ts
from quarrystone.operators import encode, knn, linear, misc


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame(list(zip(*cols.values())), names)


@pytest.mark.parametrize("mode, want", [("full", [5, 6, 2, 2, 2, -8, -9]), ("valid", [2, 2, 2]), ("same", [6, 2, 2, 2, -8]), ("left", [5, 6, 2, 2, 2]), ("right", [2, 2, 2, -8, -9])])
@pytest.mark.parametrize("method", ["direct", "fft"])
def test_convolve(mode, want, method):
    assert np.allclose(ts.convolve_array(np.array([5.0, 6, 7, 8, 9]), [1, 0, -1], 0.0, method, mode), want)


def test_first_digits(spark):
    df = frame(spark, a=[1.0, -12.0, 2.0, -22.0, 3.0, 0.0, float("nan"), float("inf"), None])
    assert df.agg(ts.query_first_digit_cnt("a").alias("v")).first().v == [2, 2, 1, 0, 0, 0, 0, 0, 0]


def test_entropies():
    assert ts.sample_entropy(np.arange(100.0)) == pytest.approx(0.010471299867295437)
    assert ts.sample_entropy(np.sin(2 * np.pi * np.arange(3000) / 100)) == pytest.approx(0.16367903754688098, rel=1e-6)
    assert ts.knn_entropy(np.array([[1.0, 2], [2, 5], [10, 10]]), 1) == pytest.approx(5.675998737756144)


def test_haversine(spark):
    v = spark.range(1).select(num.haversine(F.lit(38.898556), F.lit(-77.037852), F.lit(38.897147), F.lit(-77.043934)).alias("v")).first().v
    assert v == pytest.approx(0.549, abs=1e-3)


def test_hamming_and_jaro(spark):
    df = frame(spark, a=["karolin", "karolin", "kathrin", "0000", "2173896"], b=["kathrin", "kerstin", "kerstin", "1111", "2233796"])
    assert [r.v for r in df.select(strings.str_hamming("a", "b").alias("v")).collect()] == [3, 3, 4, 4, 3]
    assert strings.jaro("FAREMVIEL", "FARMVILLE") == pytest.approx((16 / 9 + 7 / 8) / 3)
    assert strings.damerau("ca", "abc") == 2 and strings.osa("ca", "abc") == 3


def test_strings_with_nulls(spark):
    df = spark.createDataFrame([("héllo", "hello"), (None, "x"), ("", "")], "a string, b string")
    assert [r.v for r in df.select(strings.str_leven("a", "b").alias("v")).collect()] == [1, None, 0]
    assert [r.v for r in df.select(strings.str_leven("a", "b", as_bytes=True).alias("v")).collect()] == [2, None, 0]
    assert [r.v for r in df.select(strings.str_leven("a", "b", return_sim=True).alias("v")).collect()] == [0.8, None, 1.0]
    assert [r.v for r in df.select(strings.remove_diacritics("a").alias("v")).collect()] == ["hello", None, ""]
    assert df.select(strings.to_snake_case(F.lit("helloWorld HTTPServer")).alias("v")).first().v == "hello_world_http_server"


def test_ieee(spark):
    row = spark.range(1).select(num.ieee_div(1.0, 0.0).alias("a"), num.ieee_div(-1.0, 0.0).alias("b"), num.ieee_div(0.0, 0.0).alias("c"), num.ieee_ln(F.lit(0.0)).alias("d"), num.logit(F.lit(1.0)).alias("e"), num.ieee_div(F.lit(None), 1.0).alias("f")).first()
    assert row.a == math.inf and row.b == -math.inf and math.isnan(row.c) and row.d == -math.inf and row.e == math.inf and row.f is None


def test_roc_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = frame(spark, y=y.tolist(), s=s.tolist())
    assert metrics.query_roc_auc(df, "y", "s").first().roc_auc == pytest.approx(want)
    assert math.isnan(metrics.query_roc_auc(df.filter("y = 0"), "y", "s").first().roc_auc)


def test_tails():
    assert special.t_sf(2.228138852, 10) == pytest.approx(0.025, rel=1e-6)
    assert special.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, rel=1e-6)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)


def test_ttest_and_correlations(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50), rng.normal(0.3, size=50)
    df = frame(spark, a=a.tolist(), b=b.tolist())
    t = df.agg(stats.ttest_ind("a", "b").alias("t")).first().t
    assert t.statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 50 + b.var(ddof=1) / 50))
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    assert stats.kendall_tau(df, "a", "b").first().statistic == pytest.approx(s.sum() / (50 * 49))


def test_linear_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = x @ [1.5, -2.0] + 0.5 + rng.normal(scale=0.1, size=200)
    df = frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist(), y=y.tolist())
    want = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert np.allclose(linear.lin_reg(df, "a", "b", target="y", add_bias=True).first().coeffs, want)
    assert linear.lin_reg(df.withColumn("c", F.col("a") * 2), "a", "c", target="y", singular_x_tol=1e-12).first().coeffs is None
    assert np.allclose(linear.GLM("gaussian").fit_df(df, ["a", "b"], "y").coeffs(), want[:2])
    online = linear.OnlineLR(True).fit(x[:100], y[:100]).update(x[100:], y[100:])
    assert np.allclose(online.coeffs(), want[:2])
    z = (y > 0).astype(int)
    lz = linear.logistic_reg(frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist(), z=z.tolist()), "a", "b", target="z", l2_reg=0.1)
    p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(200)]) @ lz)))
    grad = np.column_stack([x, np.ones(200)]).T @ (p - z) / 200 + 0.1 * np.append(lz[:2], 0)
    assert np.abs(grad).max() < 1e-5


def test_psi_groups_by_categories(spark):
    df = frame(spark, ref=["a"] * 50 + ["b"] * 50, act=["a"] * 80 + ["b"] * 20)
    want = (0.8 - 0.5) * math.log(0.8 / 0.5) + (0.2 - 0.5) * math.log(0.2 / 0.5)
    assert encode.psi_discrete(df, "act", "ref").first().psi == pytest.approx(want)


def test_neighbours(spark):
    df = frame(spark, id=[0, 1, 2, 3], x=[0.0, 0.1, 5.0, 5.05], y=[0.0, 0.0, 5.0, 5.0])
    got = {r.id: r.neighbours for r in knn.query_knn_ptwise(df, "x", "y", index="id", k=1).collect()}
    assert got == {0: [0, 1], 1: [1, 0], 2: [2, 3], 3: [3, 2]}
    got = {r.id: r.neighbours for r in knn.query_radius_ptwise(df, "x", "y", index="id", r=0.02).collect()}
    assert got == {0: [0, 1], 1: [1, 0], 2: [2, 3], 3: [3, 2]}


def test_splits_are_stable(spark):
    df = spark.range(1000)
    a = misc.split_by_ratio(df, 0.7, seed=3)
    b = misc.split_by_ratio(df.repartition(7), 0.7, seed=3)
    assert a.filter("__split = 'train'").count() == 700
    assert {r.id for r in a.filter("__split = 'train'").collect()} == {r.id for r in b.filter("__split = 'train'").collect()}


def test_spline_limits():
    x, y = np.arange(20.0), np.sin(np.arange(20.0))
    assert np.allclose(ts.spline_fit(x, y, 0.0), y)
    slope, base = np.polyfit(x, y, 1)
    assert np.allclose(ts.spline_fit(x, y, 1e9), slope * x + base, atol=1e-4)
