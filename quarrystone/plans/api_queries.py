"""Queries over the methods of pipelines, diagnosis, models, noise, reading and streams, and over functions whose SQL takes more than a line."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import noise, num, stats, strings, ts
from ..operators import linear, misc
from ..sources import io
from ..streaming import online
from . import diagnosis
from .blueprint import Blueprint, Pipeline
from .queries import LI, q, r

CUST, ORDERS, EVENTS = "customer", "orders", "events"


def rows(t, kind: str, *values: tuple) -> DataFrame:
    return t("region").sparkSession.createDataFrame(list(values), kind)


# --- pipelines: each method through a pipeline that was stored as text and read again


def piped(t, table: str, build, *columns: str, source=None) -> DataFrame:
    df = t(table) if source is None else source(t(table))
    pipe = Pipeline.from_json(build(Blueprint(df)).materialize().to_json())
    out = pipe.transform(df)
    return out.select(*columns) if columns else out


_NULLED = lambda d: d.selectExpr("c_custkey", "c_nationkey", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v")
q("blueprint_filter", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")(lambda t: piped(t, CUST, lambda b: b.filter("c_acctbal > 5000"), "c_custkey"))
q("blueprint_cast_bools", "SELECT c_custkey, (c_acctbal > 0)::TINYINT AS b FROM customer")(lambda t: piped(t, CUST, lambda b: b.cast_bools(), source=lambda d: d.selectExpr("c_custkey", "c_acctbal > 0 AS b")))
q("blueprint_nan_to_null", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer")(lambda t: piped(t, CUST, lambda b: b.nan_to_null(), source=lambda d: d.selectExpr("c_custkey", "CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE double('NaN') END AS v")))
q("blueprint_int_to_float", "SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey FROM customer")(lambda t: piped(t, CUST, lambda b: b.int_to_float(f32=False), source=lambda d: d.select("c_custkey", "c_nationkey")))
q("blueprint_linear_impute", "WITH d AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer), f AS (SELECT regr_slope(v, c_nationkey) AS b, regr_intercept(v, c_nationkey) AS a FROM d) SELECT c_custkey, round(coalesce(v, a + b * c_nationkey), 4) + 0.0 AS v FROM d, f")(
    lambda t: piped(t, CUST, lambda b: b.linear_impute(["c_nationkey"], "v", add_bias=True), "c_custkey", r("v", 4).alias("v"), source=_NULLED)
)
q("blueprint_center", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) + 0.0 AS c_acctbal FROM customer")(lambda t: piped(t, CUST, lambda b: b.center(["c_acctbal"]), "c_custkey", r("c_acctbal").alias("c_acctbal")))
q("blueprint_select", "SELECT c_custkey, round(c_acctbal * 2, 4) + 0.0 AS twice FROM customer")(lambda t: piped(t, CUST, lambda b: b.select("c_custkey", F.round(F.col("c_acctbal") * 2, 4).alias("twice"))))
q("blueprint_select_by_std", "SELECT c_custkey, c_acctbal FROM customer")(lambda t: piped(t, CUST, lambda b: b.select_by_std(0.5, 1e9), source=lambda d: d.selectExpr("c_custkey", "c_acctbal", "1.0D AS same", "c_acctbal * 1e12 AS wide")))
q("blueprint_winsorize", "WITH s AS (SELECT list_sort(list(c_acctbal)) AS l, count(*) - 1 AS n FROM customer), b AS (SELECT l[floor(n * 0.05 + 0.5)::INT + 1] AS lo, l[floor(n * 0.95 + 0.5)::INT + 1] AS hi FROM s) SELECT c_custkey, least(greatest(c_acctbal, lo), hi) AS c_acctbal FROM customer, b")(
    lambda t: piped(t, CUST, lambda b: b.winsorize(["c_acctbal"]), "c_custkey", "c_acctbal")
)
q("blueprint_drop", "SELECT r_name FROM region")(lambda t: piped(t, "region", lambda b: b.drop(["r_regionkey"]), source=lambda d: d.select("r_regionkey", "r_name")))
q("blueprint_rename", "SELECT r_regionkey AS k, r_name AS name FROM region")(lambda t: piped(t, "region", lambda b: b.rename({"r_regionkey": "k", "r_name": "name"}), "k", "name"))
q("blueprint_with_columns", "SELECT c_custkey, (c_nationkey + 1)::BIGINT AS n FROM customer")(lambda t: piped(t, CUST, lambda b: b.with_columns((F.col("c_nationkey") + 1).alias("n")), "c_custkey", F.col("n").cast("long").alias("n")))
q("blueprint_explode", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")(lambda t: piped(t, "part", lambda b: b.explode("w"), source=lambda d: d.select("p_partkey", F.split("p_name", " ").alias("w"))))
q("blueprint_sort_limit", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")(lambda t: piped(t, CUST, lambda b: b.sort(["c_acctbal", "c_custkey"], descending=[True, False]), "c_custkey").limit(7))
q("blueprint_append_fit_func", "SELECT c_custkey, round(c_acctbal / (SELECT max(c_acctbal) FROM customer), 6) + 0.0 AS c_acctbal FROM customer")(
    lambda t: piped(t, CUST, lambda b: b.append_fit_func(lambda d, cols: [(F.col(c) / F.lit(d.agg(F.max(c)).first()[0])).alias(c) for c in cols], ["c_acctbal"]), "c_custkey", r("c_acctbal").alias("c_acctbal"))
)
q("blueprint_step_from_dict", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal FROM customer")(
    lambda t: piped(t, CUST, lambda b: b.append_step_from_dict({"name": "scale", "args": [["c_acctbal"]]}), "c_custkey", r("c_acctbal").alias("c_acctbal"))
)


@q("blueprint_target_and_text", "SELECT 'c_acctbal' AS target, 'Pipeline p: filter, with' AS pipeline, 'Blueprint p: filter, impute' AS blueprint")
def _target_and_text(t) -> DataFrame:
    b = Blueprint(t(CUST), "p", "c_acctbal").filter("c_custkey > 0").impute(["c_acctbal"])
    return rows(t, "target string, pipeline string, blueprint string", (b._get_target(), str(b.materialize()), str(b)))


@q("pipeline_features_io", "SELECT c_custkey, true AS refused FROM customer")
def _features_io(t) -> DataFrame:
    p = Blueprint(t(CUST)).with_columns((F.col("c_acctbal") + 1).alias("more")).materialize().with_features_out(["c_custkey"]).ensure_features_io()
    try:
        p.transform(t(CUST).drop("c_name"))
        refused = False
    except ValueError:
        refused = True
    return p.transform(t(CUST)).withColumn("refused", F.lit(refused))


q("blueprint_fit_transform", "SELECT c_custkey, (c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer) > 0.5 AS high FROM customer")(
    lambda t: Blueprint(t(CUST)).scale(["c_acctbal"], method="min_max").fit().transform(t(CUST)).select("c_custkey", (F.col("c_acctbal") > 0.5).alias("high"))
)
q("blueprint_lowercase", "SELECT c_custkey AS \"C_CUSTKEY\" FROM customer")(lambda t: Blueprint(t(CUST), uppercase=True).select("C_CUSTKEY").materialize().transform(t(CUST)))

# --- diagnosis


def named(t, names) -> DataFrame:
    return rows(t, "column string", *((n,) for n in names)) if names else t("region").select(F.lit("").alias("column")).limit(0)


_FLAGS = lambda t: t(CUST).selectExpr("c_custkey", "c_nationkey", "'x' AS same", "c_acctbal > 0 AS rich", "CASE WHEN c_custkey % 10 = 0 THEN 1.0D END AS rare", "c_custkey % 7 / 10.0D AS prob", "c_acctbal * 2 AS twice", "c_acctbal")
q("dia_infer_high_null", "SELECT 'rare' AS \"column\"")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_high_null(0.75)))
q("dia_infer_discrete", "SELECT unnest(['c_nationkey', 'same', 'rich', 'rare', 'prob']) AS \"column\"")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_discrete(0.1, 100)))
q("dia_infer_const", "SELECT unnest(['same', 'rare']) AS \"column\"")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_const()))
q("dia_infer_binary", "SELECT 'rich' AS \"column\"")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_binary()))
q("dia_infer_k_distinct", "SELECT 'prob' AS \"column\"")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_k_distinct(7)))
q("dia_infer_prob", "SELECT 'prob' AS \"column\" UNION ALL SELECT 'rare'")(lambda t: named(t, diagnosis.DIA(_FLAGS(t)).infer_prob()))
q("dia_infer_corr", "SELECT 'c_acctbal' AS x, 'twice' AS y, 1.0::DOUBLE AS corr")(lambda t: diagnosis.DIA(_FLAGS(t)).infer_corr().filter("abs(corr) BETWEEN 0.999 AND 1.001").withColumn("corr", r("corr")))
q("dia_meta", "SELECT kind, n::BIGINT AS n FROM (VALUES ('numerics', 3), ('strs', 4)) v(kind, n)")(lambda t: rows(t, "kind string, n long", *((k, len(v)) for k, v in diagnosis.DIA(t(CUST).select("c_custkey", "c_nationkey", "c_acctbal", "c_name", F.lit("a").alias("a"), F.lit("b").alias("b"), F.lit("c").alias("c"))).meta().items() if k in ("numerics", "strs"))))
q("dia_col_validation", "SELECT 0 AS rule, (SELECT count(DISTINCT c_custkey) = count(*) FROM customer) AS ok UNION ALL SELECT 1, (SELECT min(c_acctbal) >= 0 FROM customer)")(lambda t: diagnosis.DIA(t(CUST)).col_validation(F.count_distinct("c_custkey") == F.count(F.lit(1)), F.min("c_acctbal") >= 0))
q("dia_plot_corr", "SELECT a AS x, b AS y, round(c, 6) + 0.0 AS corr FROM (SELECT 'l_tax' AS a, 'l_quantity' AS b, corr(l_tax, l_quantity) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_tax, l_quantity) FROM lineitem)")(lambda t: diagnosis.DIA(t(LI)).plot_corr(["l_quantity", "l_tax"]).filter("x <> y").withColumn("corr", r("corr")))
q("dia_plot_dependency", "SELECT 'n_regionkey' AS x, 'n_nationkey' AS y")(lambda t: diagnosis.DIA(t("nation")).plot_dependency(0.01, ["n_regionkey", "n_nationkey"]).select("x", "y"))
q("dia_null_corr", "WITH d AS (SELECT CASE WHEN c_acctbal > 0 THEN 0.0 ELSE 1 END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0 END AS b FROM customer) SELECT x, y, round(CASE WHEN x = y THEN 1 ELSE (SELECT corr(a, b) FROM d) END, 6) + 0.0 AS corr FROM (VALUES ('a', 'a'), ('a', 'b'), ('b', 'a'), ('b', 'b')) v(x, y)")(
    lambda t: diagnosis.DIA(t(CUST).selectExpr("CASE WHEN c_acctbal > 0 THEN 1 END AS a", "CASE WHEN c_custkey % 3 <> 0 THEN 1 END AS b")).null_corr().withColumn("corr", r("corr"))
)
q("dia_numeric_profile", "WITH h AS (SELECT least(floor((l_quantity - 1) / 2.45), 19)::INT AS b, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT range AS b, coalesce(n, 0) AS n FROM range(20) LEFT JOIN h ON range = b) SELECT 'l_quantity' AS \"column\", count(*) AS count, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_samp(l_quantity), 6) + 0.0 AS std, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median, (SELECT list(n ORDER BY b) FROM f) AS histogram FROM lineitem")(
    lambda t: diagnosis.DIA(t(LI).select("l_quantity")).numeric_profile().select("column", "count", r("mean").alias("mean"), r("std").alias("std"), "min", "max", "median", "histogram")
)
q("partition_head", "SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 2")(lambda t: diagnosis.PartitionHelper(t("nation"), "n_regionkey").head(2).select("n_nationkey", "n_name", "n_regionkey"))
q("partition_names", "SELECT 'df' AS \"column\" UNION ALL SELECT DISTINCT n_regionkey::VARCHAR FROM nation")(lambda t: named(t, diagnosis.PartitionHelper(t("nation"), "n_regionkey").names()))
q("partition_get", "SELECT n_name FROM nation WHERE n_regionkey = 2")(lambda t: diagnosis.PartitionHelper(t("nation"), "n_regionkey").get("2").select("n_name"))
q("partition_apply", "SELECT n_regionkey::VARCHAR AS part, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'df', count(*) FROM nation")(lambda t: rows(t, "part string, n long", *diagnosis.PartitionHelper(t("nation"), "n_regionkey").apply(lambda d: d.count()).items()))
q("plot_roc_auc", "WITH d AS (SELECT (l_returnflag = 'R')::INT AS a, l_quantity AS s FROM lineitem), c AS (SELECT s, sum(a)::DOUBLE AS p, count(*)::DOUBLE AS n FROM d GROUP BY 1) SELECT s AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) + 0.0 AS tpr FROM c WINDOW w AS (ORDER BY s DESC)")(
    lambda t: _tpr(t)
)


def _tpr(t) -> DataFrame:
    from ..functions import metrics

    d = t(LI).select((F.col("l_returnflag") == "R").cast("int").alias("a"), F.col("l_quantity").cast("double").alias("s"))
    return metrics.query_tpr_fpr(d, "a", "s").filter("threshold < double('inf')").select("threshold", r("tpr").alias("tpr"))


q("plot_lin_reg_points", "SELECT 1000 AS n, true AS inside")(lambda t: diagnosis.lin_reg_points(t(LI), "l_quantity", "l_tax", 1000, 1).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("l_quantity").between(1, 50)).alias("inside")).select(F.col("n").cast("int").alias("n"), "inside"))
q("plot_pca_points", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")(lambda t: diagnosis.pca_points(t(LI), ["l_quantity", "l_tax"], "l_returnflag", 2, 10**9).groupBy("l_returnflag").agg(F.count("pc1").alias("n")))

# --- models


def coefficients(t, names, values, digits: int = 5) -> DataFrame:
    return rows(t, "feature string, v double", *((n, round(float(v), digits) + 0.0) for n, v in zip(names, values)))


_SLOPE = "SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 5) + 0.0 AS v FROM lineitem UNION ALL SELECT 'bias', round(regr_intercept(l_extendedprice, l_quantity), 5) + 0.0 FROM lineitem"
q("lr_fit_df", _SLOPE)(lambda t: coefficients(t, ["l_quantity", "bias"], [*(m := linear.LR(has_bias=True).fit_df(t(LI), ["l_quantity"], "l_extendedprice")).coeffs(), m.bias()]))


@q("lr_fit_arrays", "SELECT 'x' AS feature, round(regr_slope(s_acctbal, s_nationkey), 5) + 0.0 AS v FROM supplier UNION ALL SELECT 'bias', round(regr_intercept(s_acctbal, s_nationkey), 5) + 0.0 FROM supplier")
def _lr_fit(t) -> DataFrame:
    a = io.to_numpy(t("supplier").select("s_nationkey", "s_acctbal")).astype(float)
    m = linear.LR(has_bias=True).fit(a[:, :1], a[:, 1])
    return coefficients(t, ["x", "bias"], [*m.coeffs(), m.bias()])


q("lr_predict_df", "SELECT l_orderkey, l_linenumber, round(2 * l_quantity - l_tax + 0.5, 6) + 0.0 AS prediction FROM lineitem")(lambda t: linear.LR.from_values([2.0, -1.0], 0.5, ["l_quantity", "l_tax"]).predict_df(t(LI)).select("l_orderkey", "l_linenumber", r("prediction").alias("prediction")))
q("lr_predict_arrays", "SELECT unnest([2.5, 5.5]::DOUBLE[]) AS v")(lambda t: rows(t, "v double", *((float(v),) for v in np.ravel(linear.LR.from_values([1.0, 2.0], 0.5).predict(np.array([[0.0, 1.0], [1.0, 2.0]]))))))
q("lr_formula", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax, 6) + 0.0 AS v FROM lineitem")(lambda t: t(LI).select("l_orderkey", "l_linenumber", linear.lr_formula("l_quantity * 2 + l_tax")).select("l_orderkey", "l_linenumber", r(F.col("`l_quantity * 2 + l_tax`")).alias("v")))

# one feature and no bias: soft(xy, n l1) / (xx + n l2)
_SOFT = "SELECT l_returnflag, round((sum(l_quantity * l_extendedprice) - count(*) * {l1}) / (sum(l_quantity ** 2) + count(*) * {l2}), 5) + 0.0 AS b0 FROM lineitem GROUP BY 1"
q("lin_reg_lasso", _SOFT.format(l1=5.0, l2=0.0))(lambda t: linear.lin_reg(t(LI), "l_quantity", target="l_extendedprice", l1_reg=5.0, by="l_returnflag").select("l_returnflag", r(F.get("coeffs", F.lit(0)), 5).alias("b0")))
q("lin_reg_elastic_net", _SOFT.format(l1=1.0, l2=0.5))(lambda t: linear.lin_reg(t(LI), "l_quantity", target="l_extendedprice", l1_reg=1.0, l2_reg=0.5, by="l_returnflag").select("l_returnflag", r(F.get("coeffs", F.lit(0)), 5).alias("b0")))
q("elastic_net_model", "SELECT 'l_quantity' AS feature, round((sum(l_quantity * l_extendedprice) - count(*) * 1.0) / (sum(l_quantity ** 2) + count(*) * 0.1), 5) + 0.0 AS v FROM lineitem")(lambda t: coefficients(t, ["l_quantity"], linear.ElasticNet(1.0, 0.1).fit_df(t(LI), ["l_quantity"], "l_extendedprice").coeffs()))
q("elastic_net_predict_df", "SELECT c_custkey, round(3 * c_nationkey::DOUBLE, 6) + 0.0 AS prediction FROM customer")(lambda t: linear.ElasticNet.from_values([3.0], 0.0, ["c_nationkey"]).predict_df(t(CUST)).select("c_custkey", r("prediction").alias("prediction")))
q("lin_reg_nnls", "SELECT l_returnflag, round(greatest(regr_slope(l_extendedprice, l_quantity), 0), 4) + 0.0 AS b0, round(greatest(regr_slope(-l_extendedprice, l_quantity), 0), 4) + 0.0 AS b1 FROM lineitem GROUP BY 1")(lambda t: _nnls(t))


def _nnls(t) -> DataFrame:
    up = linear.lin_reg(t(LI), "l_quantity", target="l_extendedprice", add_bias=True, positive=True, by="l_returnflag")
    down = linear.lin_reg(t(LI), "l_quantity", target="-l_extendedprice", add_bias=True, positive=True, by="l_returnflag")
    first = lambda d, n: d.select("l_returnflag", r(F.get("coeffs", F.lit(0)), 4).alias(n))
    return first(up, "b0").join(first(down, "b1"), "l_returnflag")


_NE2 = "WITH m AS (SELECT l_returnflag AS g, sum(l_quantity ** 2) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax ** 2) AS c, sum(l_quantity * l_extendedprice) AS d, sum(l_tax * l_extendedprice) AS e FROM lineitem GROUP BY 1) "
q("lin_reg_w_rcond", _NE2 + "SELECT g AS l_returnflag, round((d * c - b * e) / (a * c - b * b), 4) + 0.0 AS b0, round((a * e - b * d) / (a * c - b * b), 3) + 0.0 AS b1, round(sqrt(((a + c) + sqrt((a - c) ** 2 + 4 * b * b)) / 2), 4) + 0.0 AS s0 FROM m")(
    lambda t: linear.lin_reg_w_rcond(t(LI), "l_quantity", "l_tax", target="l_extendedprice", rcond=1e-9, by="l_returnflag").select("l_returnflag", r(F.get("coeffs", F.lit(0)), 4).alias("b0"), r(F.get("coeffs", F.lit(1)), 3).alias("b1"), r(F.get("singular_values", F.lit(0)), 4).alias("s0"))
)
q("lin_reg_multi", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS price, round(regr_slope(l_linenumber, l_quantity), 6) + 0.0 AS number FROM lineitem GROUP BY 1")(lambda t: _multi(t))


def _multi(t) -> DataFrame:
    d = linear.lin_reg(t(LI), "l_quantity", target=["l_extendedprice", "l_linenumber"], add_bias=True, by="l_returnflag")
    c = [n for n in d.columns if n != "l_returnflag"]
    if len(c) >= 2:
        pick = lambda n: F.get(n, F.lit(0))
        return d.select("l_returnflag", r(pick(c[0]), 4).alias("price"), r(pick(c[1])).alias("number"))
    return d.select("l_returnflag", r(F.get(F.get(c[0], F.lit(0)), F.lit(0)), 4).alias("price"), r(F.get(F.get(c[0], F.lit(1)), F.lit(0))).alias("number"))


# a model of one 0/1 feature gives each group its own mean
_RATES = "WITH g AS (SELECT avg({y}) FILTER (WHERE x = 1) AS p1, avg({y}) FILTER (WHERE x = 0) AS p0 FROM (SELECT *, (l_linestatus = 'F')::INT AS x FROM lineitem)) "
q("glm_poisson", _RATES.format(y="l_linenumber") + "SELECT 'x' AS feature, round(ln(p1 / p0), 5) + 0.0 AS v FROM g UNION ALL SELECT 'bias', round(ln(p0), 5) + 0.0 FROM g")(
    lambda t: coefficients(t, ["x", "bias"], [*(m := linear.GLM("poisson").fit_df(t(LI).withColumn("x", (F.col("l_linestatus") == "F").cast("double")), ["x"], "l_linenumber")).coeffs(), m.bias()])
)
q("logistic_reg", _RATES.format(y="(l_returnflag = 'R')::INT") + "SELECT 'x' AS feature, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 3) + 0.0 AS v FROM g UNION ALL SELECT 'bias', round(ln(p0 / (1 - p0)), 3) + 0.0 FROM g")(lambda t: _logistic(t))


def _logistic(t) -> DataFrame:
    d = t(LI).withColumn("x", (F.col("l_linestatus") == "F").cast("double"))
    return coefficients(t, ["x", "bias"], linear.logistic_reg(d, "x", target="l_returnflag = 'R'"), 3)


@q("glm_predict", "SELECT unnest([round(exp(0.5), 6), round(exp(1.5), 6)]) AS v")
def _glm_predict(t) -> DataFrame:
    m = linear.GLM("poisson")
    m._take(np.array([1.0, 0.5]))
    m.feature_names_in_ = ["x"]
    d = m.predict_df(rows(t, "x double", (0.0,), (1.0,)))
    assert np.allclose(sorted(x.prediction for x in d.collect()), np.ravel(m.predict(np.array([[0.0], [1.0]]))))
    return d.select(r("prediction").alias("v"))


q("online_lr_model", "SELECT 'l_quantity' AS feature, round(sum(l_quantity * l_extendedprice) / sum(l_quantity ** 2), 5) + 0.0 AS v FROM lineitem")(
    lambda t: coefficients(t, ["l_quantity"], linear.OnlineLR().update_df(t(LI).filter("l_linenumber < 4"), ["l_quantity"], "l_extendedprice").update_df(t(LI).filter("l_linenumber >= 4"), ["l_quantity"], "l_extendedprice").coeffs())
)


@q("online_lr_arrays", "SELECT 'x' AS feature, round(sum(s_nationkey * s_acctbal) FILTER (WHERE s_suppkey % 2 = 0) / sum(s_nationkey ** 2) FILTER (WHERE s_suppkey % 2 = 0), 5) + 0.0 AS v FROM supplier")
def _online(t) -> DataFrame:
    a = io.to_numpy(t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")).astype(float)
    odd = a[:, 0] % 2 == 1
    m = linear.OnlineLR().fit(a[:, 1:2], a[:, 2]).update(a[odd, 1:2], a[odd, 2], c=-1.0)  # all rows, then the odd ones taken out
    again = linear.OnlineLR.from_coeffs_bias_inverse(m.coeffs(), 0.0, m.inv())
    return coefficients(t, ["x"], again.coeffs())


# balanced groups: the fixed effect of a feature within groups is the within-group slope if it has the same mean in each
q("mixed_model", "SELECT 'Intercept' AS effect, round(avg(y), 4) + 0.0 AS estimate, (SELECT count(DISTINCT g) - 1 FROM d0)::DOUBLE AS df FROM d0 UNION ALL SELECT 'x', round(regr_slope(y, x), 4) + 0.0, (SELECT count(*) - count(DISTINCT g) - 1 FROM d0)::DOUBLE FROM d0".replace("FROM d0", "FROM (SELECT event_id % 20 AS g, (event_id // 20) % 4 - 1.5 AS x, value + event_id % 20 AS y FROM events WHERE event_id < 4000)"))(
    lambda t: rows(t, "effect string, estimate double, df double", *((x["effect"], round(x["estimate"], 4) + 0.0, x["df"]) for x in linear.MixedModel().fit_df(t(EVENTS).filter("event_id < 4000").selectExpr("event_id % 20 AS g", "(event_id div 20) % 4 - 1.5D AS x", "value + event_id % 20 AS y"), ["x"], "y", "g").report()))
)
_MC = "WITH m AS (SELECT covar_pop(l_quantity, l_linenumber) * count(*) AS c, var_pop(l_quantity) * count(*) AS a, var_pop(l_linenumber) * count(*) AS b FROM lineitem), e AS (SELECT ((a + b) + sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS l1, ((a + b) - sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS l2, b, c FROM m) "
q("singular_values", _MC + "SELECT 's0' AS feature, round(sqrt(l1), 4) + 0.0 AS v FROM e UNION ALL SELECT 's1', round(sqrt(l2), 4) + 0.0 FROM e")(lambda t: coefficients(t, ["s0", "s1"], linear.singular_values(t(LI), "l_quantity", "l_linenumber"), 4))
q("pca", _MC + "SELECT round(sqrt(l1), 4) + 0.0 AS singular_value, round(abs((l1 - b) / sqrt((l1 - b) ** 2 + c * c)), 6) + 0.0 AS w FROM e UNION ALL SELECT round(sqrt(l2), 4) + 0.0, round(abs((l2 - b) / sqrt((l2 - b) ** 2 + c * c)), 6) + 0.0 FROM e")(lambda t: linear.pca(t(LI), "l_quantity", "l_linenumber").select(r("singular_value", 4).alias("singular_value"), r(F.abs(F.get("weight_vector", F.lit(0)))).alias("w")))
q("lin_reg_report_hc3", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem), e AS (SELECT l_quantity - mx AS d, (l_extendedprice - a - b * l_quantity) / (1 - 1.0 / n - (l_quantity - mx) ** 2 / sxx) AS u, sxx, b FROM lineitem, m) SELECT round(any_value(b), 4) + 0.0 AS beta, round(sqrt(sum(d * d * u * u)) / any_value(sxx), 5) + 0.0 AS std_err FROM e")(
    lambda t: linear.lin_reg_report(t(LI), "l_quantity", target="l_extendedprice", add_bias=True, std_err="hc3").filter("features = 'l_quantity'").select(r("beta", 4).alias("beta"), r("std_err", 5).alias("std_err"))
)
q("query_ar_coeffs", "WITH d AS (SELECT event_type, value AS y, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), m AS (SELECT event_type, covar_pop(y, x1) AS y1, covar_pop(y, x2) AS y2, var_pop(x1) AS a, var_pop(x2) AS c, covar_pop(x1, x2) AS b, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM d WHERE x2 IS NOT NULL GROUP BY 1), s AS (SELECT *, (y1 * c - y2 * b) / (a * c - b * b) AS b1, (y2 * a - y1 * b) / (a * c - b * b) AS b2 FROM m) SELECT event_type, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(my - b1 * m1 - b2 * m2, 5) + 0.0 AS bias FROM s")(
    lambda t: linear.query_ar_coeffs(t(EVENTS), "value", 2, "event_id", by="event_type").select("event_type", *(r(F.get("coeffs", F.lit(i)), d).alias(n) for i, (n, d) in enumerate((("b1", 6), ("b2", 6), ("bias", 5)))))
)
q("query_ar_coeffs_whole", "WITH d AS (SELECT value AS y, lag(value) OVER (ORDER BY event_id) AS x FROM events) SELECT round(regr_slope(y, x), 6) + 0.0 AS b1 FROM d")(lambda t: linear.query_ar_coeffs(t(EVENTS), "value", 1, "event_id").select(r(F.get("coeffs", F.lit(0))).alias("b1")))
q("rolling_lin_reg_whole", "WITH d AS (SELECT event_id, sum(user_id * value) OVER w / sum(user_id * user_id) OVER w AS b, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY event_id ROWS 19 PRECEDING)) SELECT event_id, CASE WHEN n >= 20 THEN round(b, 6) + 0.0 END AS b0 FROM d")(lambda t: linear.rolling_lin_reg(t(EVENTS), "user_id", target="value", window_size=20, order_by="event_id").select("event_id", r(F.get("coeffs", F.lit(0))).alias("b0")))
q("recursive_lin_reg_whole", "WITH d AS (SELECT event_id, sum(user_id * value) OVER w / sum(user_id * user_id) OVER w AS b, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY event_id)) SELECT event_id, CASE WHEN n >= 10 THEN round(b, 6) + 0.0 END AS b0 FROM d")(lambda t: linear.recursive_lin_reg(t(EVENTS), "user_id", target="value", start_with=10, order_by="event_id").select("event_id", r(F.get("coeffs", F.lit(0))).alias("b0")))

# --- functions

_DG = "+".join(f"1 / (x + {i})" for i in range(10))
q("digamma", f"WITH d AS (SELECT DISTINCT p_size, p_size / 10.0 AS x, p_size / 10.0 + 10 AS y FROM part) SELECT p_size, round(ln(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) + 1 / (240 * y ** 8) - ({_DG}), 6) + 0.0 AS v FROM d")(lambda t: t("part").select("p_size").distinct().select("p_size", r(num.digamma(F.col("p_size") / 10.0)).alias("v")))
# the least of averages that end later, the greatest of those over begins
q("isotonic_regression", "WITH e AS (SELECT event_id % 400 AS g, value AS y, row_number() OVER (PARTITION BY event_id % 400 ORDER BY event_id) - 1 AS i FROM events), s AS (SELECT g, i, sum(y) OVER (PARTITION BY g ORDER BY i) AS upto, y FROM e), p AS (SELECT a.g, a.i AS j, b.i AS k, (b.upto - a.upto + a.y) / (b.i - a.i + 1) AS m FROM s a JOIN s b ON a.g = b.g AND a.i <= b.i), q AS (SELECT e.g, e.i, p.j, min(p.m) AS least FROM e JOIN p ON p.g = e.g AND p.j <= e.i AND p.k >= e.i GROUP BY ALL) SELECT g, i, round(max(least), 6) + 0.0 AS value FROM q GROUP BY g, i")(
    lambda t: ts.isotonic_regression(t(EVENTS).withColumn("g", F.col("event_id") % 400), "value", "event_id", by="g").select("g", "i", r("value").alias("value"))
)
_M = "avg(pow(l_quantity - m, {k}))"
q("normal_test", f"WITH a AS (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), c AS (SELECT l_returnflag, count(*)::DOUBLE AS n, {_M.format(k=2)} AS m2, {_M.format(k=3)} AS m3, {_M.format(k=4)} AS m4 FROM a GROUP BY 1), s AS (SELECT *, m3 / pow(m2, 1.5) AS g, m4 / (m2 * m2) AS k FROM c), "
  "u AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM s), "
  "w AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM u), z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS cube FROM w), "
  "f AS (SELECT l_returnflag, z1 * z1 + pow((1 - 2 / (9 * a) - sign(cube) * pow(abs(cube), 1 / 3.0)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z) SELECT l_returnflag, round(k2, 3) + 0.0 AS statistic FROM f")(
    lambda t: t(LI).groupBy("l_returnflag").agg(stats.normal_test("l_quantity").alias("s")).select("l_returnflag", r("s.statistic", 3).alias("statistic"))
)
q("xi_corr", "WITH d AS (SELECT o_orderkey AS x, o_totalprice AS y, count(*) OVER () AS n FROM orders), k AS (SELECT x, n, count(*) OVER (ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER (ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM d), s AS (SELECT n, l, abs(r - lag(r) OVER (ORDER BY x)) AS step FROM k) SELECT round(1 - any_value(n)::DOUBLE * sum(step) / (2 * sum(l::DOUBLE * (n - l))), 6) + 0.0 AS statistic FROM s")(lambda t: stats.xi_corr(t(ORDERS), "o_orderkey", "o_totalprice").select(r("statistic").alias("statistic")))

_SERIES = "WITH e AS (SELECT user_id AS g, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT g, i, n, y AS a, lead(y, 1) OVER w AS b, lead(y, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY g ORDER BY i)), d AS (SELECT g, {r} AS r FROM e GROUP BY g), "
q("query_sample_entropy", _SERIES.format(r="0.2 * stddev_pop(y)") + "p AS (SELECT x.g, any_value(x.n) AS n, count(*) FILTER (WHERE x.b IS NOT NULL AND z.b IS NOT NULL) AS b, count(*) FILTER (WHERE x.c IS NOT NULL AND z.c IS NOT NULL AND abs(x.c - z.c) <= r) AS a FROM t x JOIN d ON x.g = d.g JOIN t z ON x.g = z.g AND x.i <> z.i AND abs(x.a - z.a) <= r AND abs(x.b - z.b) <= r GROUP BY x.g) "
  "SELECT g AS user_id, CASE WHEN e.n >= 4 AND a > 0 AND b > 0 THEN round(ln(b::DOUBLE / a), 6) + 0.0 END AS value FROM (SELECT g, any_value(n) AS n FROM e GROUP BY g) e LEFT JOIN p USING (g)")(lambda t: ts.query_sample_entropy(t(EVENTS), "value", ["ts", "event_id"], by="user_id").select("user_id", r("value").alias("value")))  # fmt: skip
_PHI = "SELECT x.g, avg(ln(k::DOUBLE / (x.n - {m} + 1))) AS phi FROM (SELECT x.g, x.i, any_value(x.n) AS n, count(*) AS k FROM t x JOIN d ON x.g = d.g JOIN t z ON x.g = z.g AND abs(x.a - z.a) <= r AND abs(x.b - z.b) <= r {more} GROUP BY x.g, x.i) x GROUP BY x.g"
q("query_approx_entropy", _SERIES.format(r="0.5 * stddev_samp(y)") + f"two AS ({_PHI.format(m=2, more='')}), three AS ({_PHI.format(m=3, more='AND abs(x.c - z.c) <= r')}) SELECT e.g AS user_id, CASE WHEN e.n > 3 THEN round(abs(three.phi - two.phi), 6) + 0.0 ELSE 'NaN'::DOUBLE END AS value FROM (SELECT g, any_value(n) AS n FROM e GROUP BY g) e LEFT JOIN two ON e.g = two.g LEFT JOIN three ON e.g = three.g")(
    lambda t: ts.query_approx_entropy(t(EVENTS), "value", 2, 0.5, ["ts", "event_id"], by="user_id").select("user_id", r("value").alias("value"))
)
_PSI = "(ln({x} + 10) - 1 / (2 * ({x} + 10)) - 1 / (12 * ({x} + 10) ** 2) + 1 / (120 * ({x} + 10) ** 4) - (" + "+".join(f"1 / ({{x}} + {i}.0)" for i in range(10)) + "))"
q("query_knn_entropy", f"WITH p AS (SELECT c_nationkey AS g, c_acctbal AS x, c_custkey AS y, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), k AS (SELECT a.g, a.y, any_value(a.n)::DOUBLE AS n, list_sort(list(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)))[4] AS far FROM p a JOIN p b ON a.g = b.g GROUP BY a.g, a.y) SELECT g AS c_nationkey, CASE WHEN any_value(n) > 3 THEN round({_PSI.format(x='any_value(n)')} - {_PSI.format(x='3.0')} + ln(pi()) + 2 * avg(ln(far)), 5) + 0.0 ELSE 'NaN'::DOUBLE END AS value FROM k GROUP BY g")(
    lambda t: ts.query_knn_entropy(t(CUST), "c_acctbal", "c_custkey", by="c_nationkey").select("c_nationkey", r("value", 5).alias("value"))
)
# mean ranks over the group's size, then the entropy of their neighbours' distances, negated
q("query_copula_entropy", "WITH c AS (SELECT c_nationkey AS g, c_acctbal, c_custkey, count(*) OVER w AS n, (rank() OVER (w ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0)::DOUBLE AS rx, rank() OVER (w ORDER BY c_custkey)::DOUBLE AS ry FROM customer WINDOW w AS (PARTITION BY c_nationkey)), p AS (SELECT g, rx / n AS x, ry / n AS y, n, c_custkey AS i FROM c), "
  f"k AS (SELECT a.g, a.i, any_value(a.n)::DOUBLE AS n, list_sort(list(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)))[4] AS far FROM p a JOIN p b ON a.g = b.g GROUP BY a.g, a.i) SELECT g AS c_nationkey, round(-({_PSI.format(x='any_value(n)')} - {_PSI.format(x='3.0')} + ln(pi()) + 2 * avg(ln(far))), 5) + 0.0 AS value FROM k GROUP BY g")(
    lambda t: ts.query_copula_entropy(t(CUST), "c_acctbal", "c_custkey", by="c_nationkey").select("c_nationkey", r("value", 5).alias("value"))
)
_LCS = "WITH RECURSIVE p AS (SELECT r_name AS a, n_name AS b FROM region, nation), l AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM p UNION ALL SELECT a, b, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE row[j + 1] END])), lambda acc, x: list_append(acc, greatest(x[1], acc[len(acc)]))) FROM l WHERE i < length(a)), f AS (SELECT a, b, row[len(row)] AS n FROM l WHERE i = length(a)) "
_PAIRS = lambda t: t("region").crossJoin(t("nation")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))
q("str_lcs_subseq_dist", _LCS + "SELECT a, b, greatest(length(a), length(b)) - n AS v FROM f")(lambda t: _PAIRS(t).select("a", "b", strings.str_lcs_subseq_dist("a", "b", return_sim=False).cast("long").alias("v")))
q("str_lcs_subseq", _LCS + "SELECT a, b, n::BIGINT AS v FROM f")(lambda t: _PAIRS(t).select("a", "b", F.char_length(strings.str_lcs_subseq("a", "b")).cast("long").alias("v")))
q("str_fuzz", _LCS + "SELECT a, b, round(2.0 * n / (length(a) + length(b)), 6)::DOUBLE + 0.0 AS v FROM f")(lambda t: _PAIRS(t).select("a", "b", r(strings.str_fuzz("a", "b")).alias("v")))
q("str_lcs_substr", "WITH s AS (SELECT r_name AS a, n_name AS b, i, j FROM region, nation, range(1, 30) x(i), range(1, 30) y(j) WHERE i <= length(r_name) AND j <= length(r_name) - i + 1) SELECT a, b, coalesce(max(j) FILTER (WHERE contains(b, substr(a, i, j))), 0) AS v FROM s GROUP BY ALL")(lambda t: _PAIRS(t).select("a", "b", F.char_length(strings.str_lcs_substr("a", "b")).cast("long").alias("v")))

# --- noise: what holds of every draw

_MEAN = "SELECT true AS inside, true AS near"


def near(mean, want: float, tolerance: float):
    return (F.abs(F.avg(mean) - want) < tolerance).alias("near")


for _n, _c, _inside, _want, _tolerance in (
    ("random", lambda: noise.random(2.0, 4.0, 1), "v >= 2 AND v < 4", 3.0, 0.1),
    ("random_int", lambda: noise.random_int(0, 10, 2), "v IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)", 4.5, 0.3),
    ("random_exp", lambda: noise.random_exp(2.0, 3), "v >= 0", 0.5, 0.05),
    ("random_normal", lambda: noise.random_normal(1.0, 2.0, 4), "v IS NOT NULL", 1.0, 0.2),
    ("random_binomial", lambda: noise.random_binomial(10, 0.3, 6), "v BETWEEN 0 AND 10", 3.0, 0.2),
    ("perturb", lambda: noise.perturb(F.lit(5.0), 1.0, seed=8), "v BETWEEN 4.5 AND 5.5", 5.0, 0.05),
    ("jitter", lambda: noise.jitter(F.lit(5.0), 1.0, seed=9), "v IS NOT NULL", 5.0, 0.1),
    ("add_noise", lambda: noise.add_noise(F.lit(5.0), "uniform", epsilon=2.0, seed=9), "v BETWEEN 4 AND 6", 5.0, 0.1),
):
    q(_n, _MEAN)(lambda t, c=_c, i=_inside, w=_want, d=_tolerance: t(LI).select(c().alias("v")).agg(F.bool_and(F.expr(i)).alias("inside"), near(F.col("v"), w, d)))
q("random_str", "SELECT true AS inside, true AS near")(lambda t: t(ORDERS).select(noise.random_str(3, 6, 5).alias("v")).agg(F.bool_and(F.col("v").rlike("^[a-zA-Z0-9]{3,6}$")).alias("inside"), near(F.char_length("v"), 4.5, 0.2)))
q("random_null", "SELECT true AS inside, true AS near")(lambda t: t(LI).select("l_orderkey", noise.random_null("l_orderkey", 0.2, 7).alias("v")).agg(F.bool_and(F.coalesce(F.col("v") == F.col("l_orderkey"), F.lit(True))).alias("inside"), near(F.col("v").isNull().cast("int"), 0.2, 0.03)))
q("random_columns", "SELECT ['o_orderkey', 'o_custkey'] AS kept, 4 AS n, true AS known")(lambda t: _random_cols(t))


def _random_cols(t) -> DataFrame:
    got = misc.random_cols(t(ORDERS).columns, 2, ["o_orderkey", "o_custkey"], seed=3)
    return rows(t, "kept array<string>, n int, known boolean", (got[:2], len(set(got)), set(got) <= set(t(ORDERS).columns)))


q("sample_n", "SELECT 100 AS n, true AS known")(lambda t: misc.sample(t(ORDERS), 100, seed=1).join(t(ORDERS).select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("o_orderkey") == 100).alias("known")).select(F.col("n").cast("int").alias("n"), "known"))
q("sample_replace", "SELECT 5000 AS n, true AS known")(lambda t: misc.sample(t(CUST), 5000, replace=True, seed=1).join(t(CUST).select("c_custkey"), "c_custkey", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.count_distinct("c_custkey") > 800).alias("known")))

q("frame_transpose", "SELECT 'n' AS \"column\", max(n) FILTER (WHERE l_returnflag = 'A') AS \"A\", max(n) FILTER (WHERE l_returnflag = 'N') AS \"N\", max(n) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM (SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1) UNION ALL "
  "SELECT 's', max(s) FILTER (WHERE l_returnflag = 'A'), max(s) FILTER (WHERE l_returnflag = 'N'), max(s) FILTER (WHERE l_returnflag = 'R') FROM (SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1)")(lambda t: misc.transpose(t(LI).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("s")), "l_returnflag"))  # fmt: skip

# --- reading, writing, streams


@q("io_round_trip", "SELECT c_custkey, c_name FROM customer")
def _round_trip(t) -> DataFrame:
    d = t(CUST).select("c_custkey", "c_name")
    return io.from_arrays(d.sparkSession, **{c: [getattr(x, c) for batch in io.collect_batches(d, 100) for x in batch] for c in d.columns})


q("io_csv", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")(lambda t: _through(t, "csv", header=True, schema="r_regionkey long, r_name string"))
q("io_json", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")(lambda t: _through(t, "json", schema="r_regionkey long, r_name string"))


def _through(t, kind: str, schema: str, **options) -> DataFrame:
    d = t("region").select("r_regionkey", "r_name")
    path = f"{d.sparkSession.conf.get('spark.sql.warehouse.dir')}/io_{kind}_{next(tempfile._get_candidate_names())}"
    io.write(d, path, kind, mode="overwrite", **options)
    return d.sparkSession.read.format(kind).schema(schema).options(**options).load(path)


q("compat_functions", "SELECT v, round(1 / (1 + exp(-v)), 6) AS e FROM (SELECT unnest([-1.0, 0.0, 2.0]::DOUBLE[]) AS v)")(lambda t: rows(t, "v double, e double", *((v, round(e, 6)) for v, e in zip([-1.0, 0.0, 2.0], io.Compat(t("region").sparkSession, num).expit([-1.0, 0.0, 2.0])))))


def streamed(t, table: str, make, name: str) -> DataFrame:
    """All that a stream over the table's file gives until its input ends."""
    d = t(table)
    spark = d.sparkSession
    files = d.inputFiles()
    source = spark.readStream.schema(d.schema).parquet(files[0].rsplit("/", 1)[0] + f"/{table}.parquet*" if len(files) == 1 else files[0].rsplit("/", 1)[0])
    name = f"{name}_{next(tempfile._get_candidate_names())}"
    query = make(source).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


q("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(sum(value), 3) + 0.0 AS v FROM events GROUP BY 1")(
    lambda t: streamed(t, EVENTS, lambda s: online.windowed(s, "ts", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")], "1 day", "10 minutes"), "tumbling").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", r("v", 3).alias("v"))
)
q("lin_reg_report_bias", "WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT round(a, 3) + 0.0 AS beta FROM m")(lambda t: linear.lin_reg_report(t(LI), "l_quantity", target="l_extendedprice", add_bias=True).filter("features <> 'l_quantity'").select(r("beta", 3).alias("beta")))
q("stream_rowwise", "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")(lambda t: streamed(t, EVENTS, lambda s: s.filter("value > 20").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "rowwise"))
