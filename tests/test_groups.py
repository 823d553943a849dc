"""Many groups in one call, and what was found on larger tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.core import groups
from quarrystone.functions import ts

RNG = np.random.default_rng(3)


def series_of(spark, sizes):
    """(g, i, x): groups of the given sizes; the last one's key is null."""
    rows = [(None if g == len(sizes) - 1 else g, i, float(RNG.integers(-9, 9))) for g, n in enumerate(sizes) for i in range(n)]
    RNG.shuffle(rows)
    return spark.createDataFrame([(None if g is None else int(g), int(i), x) for g, i, x in rows], "g long, i int, x double"), {k: np.array([r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]) for k in {r[0] for r in rows}}


SIZES = [3, 4, 3, 17, 3, 40, 5, 4, 30_000, 6]


@pytest.mark.parametrize("mode", ["full", "same", "left", "right", "valid"])
@pytest.mark.parametrize("method", ["direct", "fft"])
def test_convolve_groups(spark, mode, method):
    df, want = series_of(spark, SIZES)
    got = {}
    for r in ts.convolve(df, "x", [1.0, 0.5, -1.0], "i", method=method, mode=mode, by="g").orderBy("i").collect():
        got.setdefault(r.g, []).append(r.value)
    assert got.keys() == want.keys()
    for g, x in want.items():
        assert np.allclose(got[g], ts.convolve_array(x, [1.0, 0.5, -1.0], mode=mode))


def test_convolve_calls(spark):
    """Small groups share a call of the kernel (a call and a frame for each took the time of large tables)."""
    df = spark.range(30_000, numPartitions=1).select((F.col("id") % 10_000).alias("g"), F.lit(1.0).alias("x"), "id")

    def count(sizes, x):
        return (np.arange(len(sizes)) == 0).astype(int), np.array([len(sizes)])  # a row a call

    calls = groups.kernel(df, ["x"], "id", ["g"], count, "n long").collect()
    assert sum(r.n for r in calls) == 10_000 and len(calls) <= 100


def test_convolve_short_group(spark):
    df, _ = series_of(spark, [2, 5])
    with pytest.raises(Exception, match="no longer than the series"):
        ts.convolve(df, "x", [1.0, 0.0, -1.0], "i", by="g").collect()


def test_rfft_query_stops_where_its_sql_does(spark, tmp_path):
    """A group of 17 rows has the frequencies 0 to 8; the query's SQL asks for 0 to 7, the function gives all."""
    from quarrystone.plans.queries import QUERIES

    df, want = series_of(spark, [17, 3])
    full = ts.rfft(df, "x", "i", by="g").orderBy("i").collect()
    assert np.allclose([complex(r.re, r.im) for r in full if r.g == 0], np.fft.rfft(want[0]))
    df.selectExpr("coalesce(g, 1L) AS l_orderkey", "i AS l_linenumber", "x AS l_quantity", "x AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["rfft"](spark, str(tmp_path)).collect()
    assert sorted(r.i for r in got if r.l_orderkey == 0) == list(range(8)) and sorted(r.i for r in got if r.l_orderkey == 1) == [0, 1]


def test_radius_near_ties(spark):
    """Squares are rounded as the C library's pow does: points a bit apart in distance stand as in SQL."""
    import math

    from quarrystone.operators import knn

    x = RNG.uniform(-11, 11, 200_000)
    want = np.array([math.pow(v, 2.0) for v in x])
    odd = np.flatnonzero(want != x * x)
    assert len(odd) and (knn.libm_square(x) == want).all()
    # b is as far along y as c is by x * x along x, and comes later in the id: only pow tells them apart
    v, far = next((abs(float(x[i])), want[i]) for i in odd if want[i] < x[i] * x[i])
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, math.nextafter(float(v), 99)), (3, float(v), 0.0)], "id long, x double, y double")
    assert knn.query_radius_ptwise(df, "x", "y", index="id", r=float(far)).filter("id = 1").first().neighbours == [1, 3]


@pytest.mark.parametrize("dist", ["l1", "l2", "sql2", "inf"])
def test_radius_against_all_pairs(spark, dist, monkeypatch):
    from quarrystone.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "PAIRS", 512)
    v = np.round(RNG.uniform(-2, 2, (300, 2)), 1)
    v[7, 0], v[8, 1] = np.nan, np.inf
    df = spark.createDataFrame([(f"p{i:03d}", float(a), float(b), float(i % 3) / 2) for i, (a, b) in enumerate(v)], "id string, x double, y double, r double")
    d = knn._np_dist(v, v, dist)
    lists = {r.id: r.neighbours for r in knn.query_radius_ptwise_null_safe(df, "x", "y", index="id", r=0.75, dist=dist).collect()}
    counts = {r.id: r["count"] for r in knn.query_nb_cnt(df, "x", "y", index="id", r="r", dist=dist).collect()}
    freq = {r.id: r["count"] for r in knn.query_radius_freq_cnt(df, "x", "y", index="id", r=0.75, dist=dist).collect()}
    assert len(lists) == 300 and lists["p007"] is None and lists["p008"] is None and len(counts) == len(freq) == 298
    for i in set(range(300)) - {7, 8}:
        near = np.flatnonzero(d[i] <= 0.75)
        assert lists[f"p{i:03d}"] == [f"p{j:03d}" for j in near[np.lexsort((near, d[i][near]))]] and freq[f"p{i:03d}"] == len(near)
        assert counts[f"p{i:03d}"] == (d[i] <= (i % 3) / 2).sum()


@pytest.mark.parametrize("dist", ["l2", "inf"])
def test_kth_distances(dist):
    """The tree finds exactly the distances that all pairs give, ties and copies too."""
    for n in (4, 33, 700):
        for x in (RNG.normal(size=(n, 3)), np.round(RNG.normal(size=(n, 2)), 1), np.ones((n, 2)), RNG.normal(size=(n, 1))):
            diff = np.abs(x[:, None, :] - x[None, :, :])
            d = np.sqrt((diff * diff).sum(-1)) if dist == "l2" else diff.max(-1)
            assert (ts.kth_distances(x, 3, dist) == np.sort(d, axis=1)[:, 3]).all()


def test_kth_distances_meets_few_pairs(monkeypatch):
    """Work grows with the points, not with their pairs."""
    met = []
    concatenate = np.concatenate
    monkeypatch.setattr(ts.np, "concatenate", lambda parts, axis=0: (met.append(parts[-1].size), concatenate(parts, axis=axis))[1])
    for n in (10_000, 40_000):
        met.append(0)
        ts.kth_distances(RNG.random((n, 2)), 3)
        last, met[:] = sum(met), []
        assert last < 600 * n


def test_kendall_groups(spark, monkeypatch):
    """Groups of all sizes, ties, nulls and NaN; groups share calls, so that their number costs no call each."""
    from quarrystone.functions import stats

    rows = []
    for g, n in enumerate([1, 2, 2, 3, 10, 64, 65, 300, *[7] * 50]):
        rows += [(g, float(RNG.integers(0, 5)), float(RNG.integers(0, 40))) for _ in range(n)]
    rows += [(4, None, 1.0), (4, 1.0, float("nan")), (900, None, 1.0), (5, float("inf"), 2.0), (5, float("inf"), 3.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    got = {r.g: r.statistic for r in stats.kendall_tau(df, "x", "y", by="g").collect()}
    assert len(got) == 59 and np.isnan(got[0]) and np.isnan(got[900])
    for g in got:
        v = np.array([r[1:] for r in rows if r[0] == g], float)
        v = v[~np.isnan(v).any(axis=1)]
        sx, sy = (np.sign(np.greater.outer(c, c).astype(int) - np.less.outer(c, c)) for c in v.T)
        bottom = np.sqrt(float((sx != 0).sum()) * (sy != 0).sum())
        assert np.isnan(got[g]) if not bottom else got[g] == pytest.approx((sx * sy).sum() / bottom)
    calls = []
    monkeypatch.setattr(groups, "kernel", lambda df, cols, order, by, f, kind: calls.append(f))
    stats.kendall_tau(df, "x", "y", by="g")
    monkeypatch.setattr(stats, "_tau", lambda x, y: pytest.fail("a small group by itself"))
    sizes, out = calls[0](np.full(100, 9), RNG.random(900), RNG.random(900))
    assert len(out) == 100 and (sizes == 1).all()


def test_discounts():
    from quarrystone.functions import metrics

    upto = np.append(0.0, np.cumsum(1 / np.log(np.arange(1, 3_000_001) + 1.0)))
    begin = np.array([0, 0, 3, 4090, 4095, 4096, 4096, 5000, 100_000, 0, 2_999_999, 7])
    end = np.array([1, 4096, 3, 5000, 4097, 4100, 3_000_000, 5033, 2_000_000, 3_000_000, 3_000_000, 1_000_000])
    assert np.allclose(metrics.discounts(begin, end), upto[end] - upto[begin], rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("k", [None, 7])
@pytest.mark.parametrize("ignore_ties", [False, True])
def test_dcg_rows(spark, k, ignore_ties, monkeypatch):
    """Against the ranks of single rows; and only distinct scores are ordered, so that a large group is no task's to sort."""
    from quarrystone.functions import metrics

    rows = [(g, float(RNG.integers(0, 4)), float(RNG.integers(0, 6)) if i % 5 else None) for g in range(3) for i in range(40)] + [(0, None, 2.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, y double, s double")
    sizes, running = [], metrics.running
    monkeypatch.setattr(metrics, "running", lambda d, *a, **o: (sizes.append(d.count()), running(d, *a, **o))[1])
    got = {r.g: r.dcg for r in metrics.query_dcg_score(df, "y", "s", k=k, ignore_ties=ignore_ties, by="g").collect()}
    assert sizes[0] <= 3 * 7 * 5 + 2
    for g in range(3):
        v = sorted(((-1.0 if s is None else s, -9.0 if y is None else y) for h, y, s in rows if h == g), reverse=True)
        w = [1 / np.log2(i + 2) if not k or i < k else 0.0 for i in range(len(v))]
        gain = [y if ignore_ties else np.mean([b for a, b in v if a == s and b >= 0]) for s, y in v]
        assert got[g] == pytest.approx(sum(a * b for a, b in zip(gain, w) if a >= 0))


def test_sample_sorts_no_rows(spark, monkeypatch):
    """The rows of the least keys, as many as asked for; all of them, if there are no more; copies too."""
    from quarrystone.operators import misc

    monkeypatch.setattr(misc, "TOP_ROWS", 50)
    monkeypatch.setattr(misc, "numbered", lambda *a, **o: pytest.fail("rows are sorted"))
    df = spark.range(2_000).select((F.col("id") % 700).alias("v"))
    key = {r.v: r.k for r in df.select("v", F.xxhash64(F.lit(5), "v").alias("k")).distinct().collect()}
    for n in (51, 700, 1_999):
        got = sorted(key[r.v] for r in misc.sample(df, n, seed=5).collect())
        assert got == sorted(key[i % 700] for i in range(2_000))[:n]
    assert misc.sample(df, 10**9, seed=5).count() == 2_000
    assert misc.sample(spark.range(300).select(F.lit(1).alias("v")), 120, seed=5).count() == 120


def test_random_str_and_binomial(spark, monkeypatch):
    """One generator a batch, all letters equally often, reruns agree."""
    from quarrystone.functions import noise

    df = spark.range(0, 20_000, 1, 3)
    cols = [noise.random_str(3, 6, 5).alias("s"), noise.random_binomial(10, 0.3, 6).alias("b")]
    got, again = df.select(*cols).collect(), df.select(*cols).collect()
    assert got == again and {len(r.s) for r in got} == {3, 4, 5, 6} and len({r.s for r in got}) > 15_000
    letters = np.unique(list("".join(r.s for r in got)), return_counts=True)[1]
    assert len(letters) == 62 and letters.min() > 0.85 * letters.mean() and letters.max() < 1.15 * letters.mean()
    assert np.mean([r.b for r in got]) == pytest.approx(3, abs=0.05) and np.var([r.b for r in got]) == pytest.approx(2.1, abs=0.1)
    assert df.select(noise.random_str(0, 0, 1).alias("s")).distinct().collect()[0].s == ""
    seen, make = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda *a: (seen.append(a), make(*a))[1])
    import pandas as pd

    for c in cols:
        u = pd.Series(make(1).random(5_000))
        f = noise.random_str if c is cols[0] else noise.random_binomial
        kept = []
        monkeypatch.setattr(noise.F, "pandas_udf", lambda kind: lambda g: (kept.append(g), lambda *x: None)[1])
        f(*((3, 6) if c is cols[0] else (10, 0.3)), 1)
        assert len(kept[0](*[u] * (2 if c is cols[0] else 1))) == 5_000
    assert len(seen) == 2


@pytest.mark.parametrize("few", [50_000, 3])
def test_exact_quantile(spark, monkeypatch, few):
    """percentile's value, for distinct and for tied values, while no more than a few are looked at together."""
    from quarrystone.core import prefix

    monkeypatch.setattr(prefix, "FEW", few)
    monkeypatch.setattr(prefix, "RANGES", 4)
    for v in (RNG.normal(size=301), RNG.integers(0, 3, 200), np.ones(5), np.array([1e300, -1e300]), np.array([2.5, np.nan, np.inf])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
        for q in (0.0, 0.25, 0.5, 0.73, 1.0):
            assert prefix.exact_quantile(df, "x", q) == df.filter("abs(x) < double('inf')").selectExpr(f"percentile(x, {q}D)").first()[0]
    assert prefix.exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_bicor_gathers_no_values(spark, monkeypatch):
    from quarrystone.functions import stats

    monkeypatch.setattr(stats, "quantile", lambda *a: pytest.fail("percentile ships every value to one task"))
    x = RNG.normal(size=400)
    y = x + RNG.normal(size=400)
    part = lambda v: (d := v - np.median(v)) * np.where(np.abs(u := d / (9 * np.median(np.abs(d)))) < 1, (1 - u * u) ** 2, 0)
    a, b = part(x), part(y)
    got = stats.bicor(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double"), "x", "y").first().statistic
    assert got == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
    assert stats.bicor(spark.createDataFrame([], "x double, y double"), "x", "y").first().statistic is None


def test_finite_compiles_in_moments(spark):
    """The generated code of the normal test stays below what the JVM compiles (8,000 bytes a method)."""
    import re

    from quarrystone.core.col import finite
    from quarrystone.functions import stats

    values = [1.5, float("nan"), float("inf"), float("-inf"), None, -0.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.v for r in df.select(finite("x").alias("v")).collect()] == [1.5, None, None, None, None, 0.0, 1.7e308]
    d = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = d.groupBy("g").agg(stats.normal_test("x").alias("s"))._jdf.queryExecution()
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8_000


def test_window_solver_takes_batches(spark, monkeypatch):
    """The windows of a batch are solved together, singular ones by least squares."""
    import pandas as pd

    from quarrystone.operators import linear

    a = RNG.normal(size=(200, 5, 2))
    a[[3, 77], :, 1] = a[[3, 77], :, 0]
    a[5] = 0
    b = RNG.normal(size=(200, 5))
    xx, xy = np.einsum("nij,nik->njk", a, a), np.einsum("nij,ni->nj", a, b)
    xx[[3, 77]] = np.round(xx[[3, 77]])
    rows = [np.array([x[0, 0], x[0, 1], x[1, 1], *y, 0.0, n, n, 0.0]) for x, y, n in zip(xx, xy, [5.0] * 199 + [4.0])]
    kept, calls, solve = [], [], np.linalg.solve
    monkeypatch.setattr(linear.F, "pandas_udf", lambda kind: lambda f: (kept.append(f), f)[1])
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: (calls.append(1), solve(a, b))[1])
    run = linear._window_solver(2, False, 0.0, 5)
    got = run(pd.Series([*rows, None], dtype=object))
    assert got[199] is None and got[200] is None and len(calls) < 60
    for i in range(199):
        assert np.allclose(got[i], np.linalg.lstsq(xx[i], xy[i], rcond=None)[0], rtol=1e-6)


@pytest.mark.parametrize("dist", ["l1", "l2", "sql2", "inf"])
def test_counted_leaves(monkeypatch, dist):
    """Counts are those of all pairs, and most pairs are counted by whole leaves."""
    from quarrystone.operators import knn

    met, near = [], knn._near
    monkeypatch.setattr(knn, "_near", lambda q, p, *a: (met.append(len(q) * len(p)), near(q, p, *a))[1])
    for p in (RNG.uniform(-2, 2, (3_000, 2)), np.round(RNG.uniform(-2, 2, (500, 2)), 1), np.ones((3, 1))):
        r = np.round(RNG.uniform(0, 2, len(p)), 1)
        assert (knn._counted(p, p, r, dist) == (knn._np_dist(p, p, dist) <= r[:, None]).sum(axis=1)).all()
    met.clear()
    p = RNG.uniform(-2, 2, (3_000, 2))
    knn._counted(p, p, np.full(3_000, 0.8), dist)
    assert sum(met) < 0.5 * 3_000**2
