"""Kernels and frame functions without SQL against plain definitions, and running sums over ranges."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.core import prefix
from quarrystone.functions import num, stats, strings, ts
from quarrystone.operators import knn, linear, misc


@pytest.fixture(autouse=True)
def _ranges(monkeypatch):
    """Small frames take the way of large ones."""
    monkeypatch.setattr(prefix, "FEW", 0)


# --- running sums

def test_few_rows_are_one_window(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "x int, v int")
    ranged = sorted(map(tuple, prefix.running(df, "x", {"upto": "v"}, ties=[F.col("v")]).collect()))
    monkeypatch.setattr(prefix, "FEW", 50)
    assert sorted(map(tuple, prefix.running(df, "x", {"upto": "v"}, ties=[F.col("v")]).collect())) == ranged


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_a_window(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice([None, float("nan"), float("inf"), *[round(rng.gauss(0, 3), 1) for _ in range(9)]]), i, rng.random(), i) for i in range(700)]
    df = spark.createDataFrame(rows, "x double, id long, v double, range_ long").repartition(5)
    got = prefix.running(df, "x", {"upto": "v", "n": "id"}, descending=descending, ties=[F.col("id")])
    assert got.columns == ["x", "id", "v", "range_", "upto", "n"]
    order = [F.desc("x") if descending else F.asc("x"), F.col("id")]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("upto", F.sum("v").over(w)).withColumn("n", F.sum("id").over(w))
    a, b = ({r.id: (round(r.upto, 8), r.n) for r in d.collect()} for d in (got, want))
    assert a == b and len(a) == 700
    assert prefix.running(df.limit(0), "x", {"upto": "v"}).count() == 0
    numbers = [r.i for r in prefix.numbered(df, "x", "i", ties=[F.col("id")]).orderBy(*(order if not descending else [F.asc("x"), F.col("id")])).collect()]
    assert numbers == list(range(1, 701))


def test_running_sums_of_strings_and_one_value(spark):
    df = spark.createDataFrame([(w, 1) for w in ["b", "é", "a", "Z", "aa", "漢", "", "a"]] + [("same", 1)] * 50, "w string, n int")
    got = prefix.running(df, "w", {"upto": "n"}).groupBy("w").agg(F.max("upto").alias("m")).collect()
    ordered = sorted([r[0] for r in df.collect()], key=lambda w: w.encode())
    assert {r.w: r.m for r in got} == {w: len(ordered) - ordered[::-1].index(w) for w in set(ordered)}


def test_blocks_see_what_the_whole_series_sees(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random()) for i in rng.sample(range(10_000), 503)], "i long, v double")
    blocked, block, own = prefix.in_blocks(df, ["i"], 6, rows=50)
    w = Window.partitionBy(block).orderBy("i").rowsBetween(-6, 0)
    got = {r.i: round(r.s, 9) for r in blocked.withColumn("s", F.sum("v").over(w)).filter(own).collect()}
    w = Window.orderBy("i").rowsBetween(-6, 0)
    assert got == {r.i: round(r.s, 9) for r in df.withColumn("s", F.sum("v").over(w)).collect()}


def test_whole_frame_functions_equal_grouped_ones(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(1, i, rng.choice([0.0, 1.0, 2.5, rng.random()]), rng.random()) for i in range(300)], "g int, i int, x double, y double")
    one = lambda d, c="statistic": round(d.first()[c], 8)
    assert one(stats.ks_2samp(df, "x", "y")) == one(stats.ks_2samp(df, "x", "y", by="g"))
    for method in ("average", "min", "max", "dense"):
        a = {r.i: r["rank"] for r in stats.ranks(df, "x", method=method).collect()}
        assert a == {r.i: r["rank"] for r in stats.ranks(df, "x", method=method, by="g").collect()}
    p = np.array([[r.x, r.y] for r in df.collect()])
    assert one(df.select((num.center("x", of=df) * num.center("x", by="g")).alias("c")).agg(F.sum("c").alias("statistic"))) == pytest.approx(((p[:, 0] - p[:, 0].mean()) ** 2).sum())
    soft = sorted(r.s for r in df.select(num.softmax("x", of=df).alias("s")).collect())
    assert soft == pytest.approx(sorted(np.exp(p[:, 0]) / np.exp(p[:, 0]).sum()))
    assert sum(r.c for r in df.select(num.z_normalize("x", of=df).alias("c")).collect()) == pytest.approx(0, abs=1e-9)
    for fit in (lambda by: linear.rolling_lin_reg(df, "x", target="y", window_size=7, order_by="i", add_bias=True, by=by), lambda by: linear.recursive_lin_reg(df, "x", target="y", start_with=5, order_by="i", by=by)):
        a, b = ({r.i: None if r.coeffs is None else [round(c, 6) for c in r.coeffs] for r in fit(by).collect()} for by in (None, "g"))
        assert a == b
    k = misc.query_kaplan_meier_prob(df, "x > 1", "y").collect()
    assert {r.t: round(r.prob, 9) for r in k} == {r.t: round(r.prob, 9) for r in misc.query_kaplan_meier_prob(df, "x > 1", "y", by="g").collect()}


def test_series_without_groups_equal_one_group(spark, monkeypatch):
    """The whole frame as blocks of 40 rows against the same rows as one group."""
    from quarrystone.functions import metrics

    rng = random.Random(15)
    df = spark.createDataFrame([(1, i // 3, i, rng.choice([0.0, 1.0, rng.random()]), rng.random()) for i in rng.sample(range(3000), 333)], "g int, t int, i int, x double, y double")
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 40)
    o = ["t", "i"]
    checks = [
        lambda by: ts.query_mean_abs_change(df, "x", o, by=by), lambda by: ts.query_cid_ce(df, "x", o, True, by=by), lambda by: ts.query_c3_stats(df, "x", 3, o, by=by),
        lambda by: ts.query_time_reversal_asymmetry_stats(df, "x", 2, o, by=by), lambda by: ts.query_auto_corr(df, "x", 5, o, by=by), lambda by: ts.query_longest_streak(df, "x > 0.5", o, by=by),
        lambda by: ts.query_avg_streak(df, "x > 0.5", o, by=by), lambda by: ts.is_increasing(df, "x", o, by=by), lambda by: ts.is_decreasing(df.withColumn("z", -F.col("i")), "z", o, by=by),
        lambda by: ts.integrate_trapz(df, "y", "i", by=by), lambda by: ts.query_similar_count(df, "x", [0.0, 1.0, 0.5], 4.0, o, by=by), lambda by: ts.query_permute_entropy(df, "y", o, 2, 3, by=by),
        lambda by: metrics.query_mase(df, "x", "y", "x", o, 7, by=by).withColumnRenamed("mase", "value"), lambda by: ts.detrend(df, "x", o, by=by).agg(F.sum(F.col("detrended") * F.col("i")).alias("value")),
        lambda by: ts.detrend(df, "x", o, "mean", by=by).agg(F.sum(F.col("detrended") * F.col("i")).alias("value")),
    ]
    for k, check in enumerate(checks):
        assert check(None).first()["value"] == pytest.approx(check("g").first()["value"]), k


def test_xi_against_its_definition(spark):
    rng = random.Random(4)
    rows = [(float(i), rng.choice([1.0, 2.0, rng.random()])) for i in rng.sample(range(500), 200)]
    y = [b for _, b in sorted(rows)]
    n = len(y)
    r = [sum(v <= u for v in y) for u in y]
    lower = [sum(v >= u for v in y) for u in y]
    want = 1 - n * sum(abs(a - b) for a, b in zip(r, r[1:])) / (2 * sum(v * (n - v) for v in lower))
    got = stats.xi_corr(spark.createDataFrame(rows, "x double, y double"), "x", "y", return_p=True).first()
    assert got.statistic == pytest.approx(want) and got.pvalue == pytest.approx(0.5 * math.erfc(want * math.sqrt(n) / math.sqrt(2 / 5) / math.sqrt(2)))


# --- kernels

def test_lempel_ziv():
    def plain(s):
        """Phrases none of which came before, read from the left."""
        seen, i, n = set(), 0, len(s)
        while i < n:
            j = i + 1
            while s[i:j] in seen and j <= n:
                j += 1
                if j > n:
                    break
            seen.add(s[i : min(j, n)])
            i = j
        return len(seen)

    rng = random.Random(5)
    for _ in range(50):
        bits = [rng.random() < 0.4 for _ in range(rng.randint(1, 60))]
        assert ts.lempel_ziv(np.array(bits)) == plain("".join("01"[b] for b in bits))


def plain_knn_entropy(x, k):
    from math import lgamma

    n, d = x.shape
    far = [sorted(math.dist(a, b) for b in x)[k] for a in x]
    psi = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, m))
    return psi(n) - psi(k) + d / 2 * math.log(math.pi) - lgamma(d / 2 + 1) + d * np.log(far).mean()


def test_entropies_of_several_series(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(60, 3))
    a[:, 2] += a[:, 0]
    rank = lambda c: np.argsort(np.argsort(c)) + 1.0
    copula = lambda *c: -plain_knn_entropy(np.column_stack([rank(x) / len(x) for x in c]), 3)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(a)], "i int, x double, y double, z double")
    value = lambda d: d.first()["value"]
    x, y, z = a.T
    assert value(ts.query_copula_entropy(df, "x", "y")) == pytest.approx(copula(x, y))
    assert value(ts.query_cond_indep(df, "x", "y", "z")) == pytest.approx(copula(x, y, z) - copula(y, z) - copula(x, z))
    assert value(ts.query_transfer_entropy(df, "x", "y", "i")) == pytest.approx(copula(x[1:], y[:-1], x[:-1]) - copula(y[:-1], x[:-1]) - copula(x[1:], x[:-1]))


def test_spline_against_a_dense_solve():
    rng = np.random.default_rng(7)
    x, y, lam = np.cumsum(rng.random(12) + 0.1), rng.normal(size=12), 0.7
    h, n = np.diff(x), len(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    want = np.linalg.solve(np.eye(n) + lam * q @ np.linalg.inv(r) @ q.T, y)
    assert np.allclose(ts.spline_fit(x, y, lam), want)


def test_optimal_alignment_distance():
    def plain(a, b):
        d = {}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 8))) for _ in "ab")
        assert strings.osa(a, b) == plain(a, b)


def test_isotonic_and_penalised_fits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = x @ [2.0, 0.0, -1.0] + 0.3 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    for l1, l2 in ((0.2, 0.0), (0.1, 0.3)):
        got = np.array(linear.lin_reg(df, "a", "b", "c", target="y", l1_reg=l1, l2_reg=l2, add_bias=True).first().coeffs)
        # conditions of the optimum: the slope of the loss equals the penalty's
        slope = x.T @ (y - x @ got[:3] - got[3]) / 80 - l2 * got[:3]
        assert abs((y - x @ got[:3] - got[3]).mean()) < 1e-3
        for g, b in zip(slope, got[:3]):
            assert abs(g - l1 * np.sign(b)) < 1e-3 if b else abs(g) <= l1 + 1e-3
    nn = np.array(linear.lin_reg(df, "a", "b", "c", target="y", positive=True).first().coeffs)
    grad = x.T @ (y - x @ nn)
    assert (nn >= 0).all() and all(abs(g) < 1e-2 if b else g <= 1e-2 for g, b in zip(grad, nn))


def test_glm_and_its_arrays(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 2))
    y = rng.poisson(np.exp(0.5 * x[:, 0] - 0.2 * x[:, 1] + 1)).astype(float)
    m = linear.GLM("poisson").fit(x, y)
    mean = np.ravel(m.predict(x))
    assert np.abs(x.T @ (y - mean)).max() < 1e-4 and abs((y - mean).sum()) < 1e-4
    assert [r.feature for r in m.report(spark.range(1)).collect()] == ["x0", "x1", "__bias__"]


def test_degrees_of_freedom_of_mixed_models(spark):
    rng = np.random.default_rng(11)
    group = np.repeat(np.arange(20), 10)
    u = rng.normal(size=20)[group]
    within, noise, between = rng.normal(size=200), rng.normal(size=200), rng.normal(size=20)[group]
    y = 1.5 + 2 * within + u + rng.normal(size=200) * 0.5
    df = spark.createDataFrame([(int(g), *map(float, r)) for g, *r in zip(group, within, noise, between, y)], "g int, x double, noise double, z double, y double")
    m = linear.MixedModel().fit_df(df, ["x", "noise", "z"], "y", "g")
    rep = m.report()
    assert [r["effect"] for r in rep] == ["Intercept", "x", "noise", "z"]
    # rows less groups and the columns that vary within them; groups less the columns that do not
    assert [r["df"] for r in rep] == [20 - 2, 200 - 20 - 2, 200 - 20 - 2, 20 - 2]
    assert abs(rep[1]["estimate"] - 2) < 0.2 and rep[1]["p_value"] < 1e-6 and rep[2]["p_value"] > 0.01 and m.gamma_ > 0


# --- neighbours and samples

def test_unknown_distances_are_refused(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id int, x double, y double")
    for dist in ("cosine", "manhatan"):
        with pytest.raises(ValueError):
            knn.query_radius_ptwise(df, "x", "y", index="id", r=1.0, dist=dist)
        with pytest.raises(ValueError):
            knn.query_nb_cnt(df, "x", "y", index="id", r=1.0, dist=dist)


def test_averages_beside_many_rows_of_one_point(spark):
    rng = np.random.default_rng(12)
    pts = np.concatenate([np.zeros((60, 2)), rng.normal(size=(40, 2))])
    t = rng.random(100)
    df = spark.createDataFrame([(i, float(a), float(b), None if i == 99 else float(v)) for i, ((a, b), v) in enumerate(zip(pts, t))], "id int, x double, y double, t double")
    got = {r.id: r.value for r in knn.query_knn_avg(df, "x", "y", index="id", target="t", k=4).collect()}
    for i in range(100):
        d = ((pts - pts[i]) ** 2).sum(axis=1)
        near = sorted((d[j], j) for j in range(99) if d[j] >= 1e-9)[:4]
        assert got[i] == pytest.approx(np.mean([t[j] for _, j in near]))


@pytest.mark.parametrize("dist", ["sql2", "l2", "l1", "inf"])
def test_neighbours_over_many_blocks(spark, monkeypatch, dist):
    """Blocks of 16 rows, clustered points, many equal ones, and a mask: as all pairs, ties by id."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(13)
    pts = np.round(np.concatenate([rng.normal(c, 0.3, size=(50, 2)) for c in ((1, 1), (5, 5), (9, 1), (40, 40))] + [np.full((30, 2), 3.0)]), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, x double, y double")
    got = {r.id: list(r.neighbours) for r in knn.query_knn_ptwise(df, "x", "y", index="id", k=3, dist=dist, data_mask=F.col("id") % 5 != 0).collect()}
    allowed = [j for j in range(len(pts)) if j % 5]
    d = knn._np_dist(pts, pts[allowed], dist)
    for i in range(len(pts)):
        assert got[i] == [j for _, j in sorted(zip(d[i], allowed))[:4]]
    assert len(got) == len(pts)


def test_large_samples(spark, monkeypatch):
    monkeypatch.setattr(misc, "TOP_ROWS", 10)
    df = spark.range(500).withColumn("key_more", F.col("id") % 3)
    got = misc.sample(df, 200, seed=3)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(r.id for r in misc.sample(df.repartition(7), 0.4, seed=3).collect())
    assert misc.sample(df, 10_000, seed=3).count() == 500


def test_a_stream_goes_on_with_its_model(spark, tmp_path):
    from quarrystone.streaming import online

    src, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "x double, y double"
    model = lambda: linear.OnlineLR()
    spark.createDataFrame([(1.0, 2.0), (2.0, 4.5)], schema).write.mode("append").parquet(src)
    first = model()
    online.online_regression(spark.readStream.schema(schema).parquet(src), first, ["x"], "y", checkpoint).awaitTermination()
    spark.createDataFrame([(3.0, 5.0)], schema).write.mode("append").parquet(src)
    second = model()  # another driver: nothing in memory
    online.online_regression(spark.readStream.schema(schema).parquet(src), second, ["x"], "y", checkpoint).awaitTermination()
    x, y = np.array([1.0, 2, 3]), np.array([2.0, 4.5, 5])
    assert second.coeffs() == pytest.approx([x @ y / (x @ x)])


# --- strings, many pairs at once

@pytest.mark.parametrize("name", ["osa", "damerau", "lcs_length", "lcs_subseq", "lcs_substr", "jaro", "jaro_winkler"])
def test_string_kernels_equal_their_plain_forms(monkeypatch, name):
    from quarrystone.functions import batch

    rng = random.Random(14)
    draw = lambda: "".join(rng.choices("abcdé漢", k=rng.choice([0, 1, 2, 3, 5, 9, 14])))
    x, y = [draw() for _ in range(600)], [draw() for _ in range(600)]
    y[:40] = x[:40]
    for cells in (1 << 21, 300, 1):
        monkeypatch.setattr(batch, "CELLS", cells)
        got = batch.over_blocks(getattr(batch, name), x, y, whole_table=name in ("damerau", "lcs_subseq"))
        want = [getattr(strings, name)(a, b) for a, b in zip(x, y)]
        assert got == (pytest.approx(want) if name.startswith("jaro") else want)


def test_string_columns_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([("ca", "abc"), ("ca", "abc"), (None, "a"), ("", ""), ("é", "e")], "a string, b string")
    col = lambda c: [r.v for r in df.select(c.alias("v")).collect()]
    assert col(strings.str_osa("a", "b")) == [3, 3, None, 0, 1] and col(strings.str_d_leven("a", "b")) == [2, 2, None, 0, 1]
    assert col(strings.str_d_leven("a", "b", as_bytes=True)) == [2, 2, None, 0, 2]
    assert col(strings.str_jaro("a", "b"))[2:] == [None, 1.0, 0.0] and col(strings.str_fuzz("a", "b")) == [0.4, 0.4, None, 1.0, 0.0]
    assert col(strings.str_lcs_subseq("a", "b"))[3:] == ["", ""] and col(strings.str_lcs_substr("a", "b"))[2] is None
    nothing = df.filter("a IS NULL")
    assert [r.v for r in nothing.select(strings.str_osa("a", "b").alias("v")).collect()] == [None]


def test_gram_similarities_equal_sets_of_bytes(spark):
    rng = random.Random(16)
    rows = [("".join(rng.choices("abé漢 ", k=rng.randint(0, 9))), "".join(rng.choices("abé漢 ", k=rng.randint(0, 9)))) for _ in range(200)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    grams = lambda t, n: {t.encode()[i : i + n] for i in range(max(1, len(t.encode()) - n + 1))} if t else set()
    for n in (1, 2, 3):
        for col, share in (
            (strings.str_jaccard("a", "b", n), lambda m, a, b: (m, a + b - m)), (strings.str_overlap_coeff("a", "b", n), lambda m, a, b: (m, min(a, b))),
            (strings.str_sorensen_dice("a", "b", n), lambda m, a, b: (2 * m, a + b)), (strings.str_tversky_sim("a", "b", 0.3, 0.7, n), lambda m, a, b: (m, m + 0.3 * (a - m) + 0.7 * (b - m))),
        ):
            for (x, y), r in zip(rows, df.select(col.alias("v")).collect()):
                if x is None or y is None:
                    assert r.v is None
                    continue
                a, b = grams(x, n), grams(y, n)
                top, bottom = share(len(a & b), len(a), len(b))
                assert r.v == pytest.approx(top / bottom) if bottom else math.isnan(r.v)
