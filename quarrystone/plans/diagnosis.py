"""Tables that describe a frame: one wide aggregation each, then turned into rows."""

from __future__ import annotations

import itertools
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.col import INF, dbl, finite, ieee_div, quantile
from ..functions import stats
from ..functions.ts import query_cond_entropy
from ..operators import misc


def E(cols, mappings, *, separator: str = "_", len_alias: str | None = "__len__", customizer=None) -> list[Column]:  # noqa: N802
    """Aggregates for each column and mapping: a name of an aggregate ("mean", "null_rate", ...) or a function of a column."""
    known = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "count": F.count, "n_unique": F.count_distinct, "first": F.first, "last": F.last, "null_count": lambda c: F.count_if(F.col(c).isNull()), "null_rate": lambda c: F.avg(F.col(c).isNull().cast("double"))}
    cols = [cols] if isinstance(cols, str) else list(cols)
    items = mappings.items() if isinstance(mappings, dict) else [(m, m) for m in ([mappings] if isinstance(mappings, str) else mappings)]
    out = [F.count(F.lit(1)).alias(len_alias)] if len_alias else []
    for c in cols:
        for name, m in items:
            e = known[m](c) if isinstance(m, str) else m(F.col(c))
            e = e.alias(f"{c}{separator}{name}")
            out.append(customizer(e) if customizer else e)
    return out


class PartitionHelper:
    """Parts of a frame by the values of keys; nothing is copied, a part is a filter."""

    def __init__(self, df: DataFrame, by, separator: str = "|", whole_df_name: str = "df") -> None:
        self.df, self.by, self.separator, self.whole = df, [by] if isinstance(by, str) else list(by), separator, whole_df_name
        self.key = F.concat_ws(separator, *(F.coalesce(F.col(b).cast("string"), F.lit("null")) for b in self.by))

    def names(self) -> list[str]:
        return [self.whole, *sorted(r[0] for r in self.df.select(self.key.alias("k")).distinct().collect())]

    def get(self, part: str) -> DataFrame:
        return self.df if part == self.whole else self.df.filter(self.key == part)

    def head(self, n: int = 5) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(*self.by).orderBy(*(F.col(c) for c in self.df.columns))
        return self.df.withColumn("i_", F.row_number().over(w)).filter(F.col("i_") <= n).drop("i_")

    def apply(self, func) -> dict:
        import warnings

        out = {}
        for name in self.names():
            try:
                out[name] = func(self.get(name))
            except Exception as e:
                warnings.warn(f"{name}: {e}", stacklevel=2)
        return out


class DIA:
    """Exploratory tables."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        kinds = {"numerics": T.NumericType, "ints": T.IntegralType, "floats": (T.DoubleType, T.FloatType), "strs": T.StringType, "bools": T.BooleanType, "dates": T.DateType, "datetimes": (T.TimestampType, T.TimestampNTZType), "lists": T.ArrayType}
        self.classes = {k: [f.name for f in df.schema if isinstance(f.dataType, t)] for k, t in kinds.items()}
        self.numerics = self.classes["numerics"]

    def meta(self) -> dict[str, list[str]]:
        return self.classes

    def _rows(self, per: dict[str, dict[str, Column]]) -> DataFrame:
        """One aggregation; a row for each column."""
        one = self.df.agg(*(F.struct(F.lit(c).alias("column"), *(e.alias(n) for n, e in es.items())).alias(f"s{i}") for i, (c, es) in enumerate(per.items())))
        return one.select(F.inline(F.array(*(F.col(f"s{i}") for i in range(len(per))))))

    def special_values_report(self) -> DataFrame:
        n = F.count(F.lit(1))
        per = {}
        for c in self.numerics:
            null, nan, inf = F.count_if(F.col(c).isNull()), F.count_if(F.isnan(dbl(c))), F.count_if(F.abs(dbl(c)) == INF)
            per[c] = {"null_count": null, "null%": ieee_div(null * 100, n), "nan_count": nan, "nan%": ieee_div(nan * 100, n), "inf_count": inf, "inf%": ieee_div(inf * 100, n)}
        return self._rows(per)

    def numeric_profile(self, n_bins: int = 20, iqr_multiplier: float = 1.5, histogram: bool = True, gt: bool = True) -> DataFrame:
        del gt
        per = {}
        for c in self.numerics:
            x = finite(c)
            per[c] = {"count": F.count(F.col(c)), "null%": F.avg(F.col(c).isNull().cast("double")) * 100, "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "q1": quantile(c, 0.25, "nearest"), "median": F.median(x), "q3": quantile(c, 0.75, "nearest"), "max": F.max(x)}
        t = self._rows(per).withColumn("IQR", F.col("q3") - F.col("q1"))
        stats_ = {r["column"]: r for r in t.collect()}  # one row a column
        more = {}
        for c, r in stats_.items():
            x = finite(c)
            lo, hi = (r.q1 - iqr_multiplier * r.IQR, r.q3 + iqr_multiplier * r.IQR) if r.q1 is not None else (0.0, 0.0)
            es = {"outliers": F.count_if((x < lo) | (x > hi))}
            if histogram:
                width = ((r["max"] - r["min"]) / n_bins if r["max"] is not None else 0) or 1.0
                b = F.least(F.floor((x - F.lit(r["min"] or 0.0)) / width), F.lit(n_bins - 1))
                es["histogram"] = F.array(*(F.count_if(b == i) for i in range(n_bins)))
            more[c] = es
        return t.join(self._rows(more), "column")

    def col_validation(self, *rules: Column) -> DataFrame:
        one = self.df.agg(*(F.struct(F.lit(i).alias("rule"), r.alias("ok")).alias(f"r{i}") for i, r in enumerate(rules)))
        return one.select(F.inline(F.array(*(F.col(f"r{i}") for i in range(len(rules))))))

    def row_validation(self, *rules, id_col: str | None = None, columns_to_keep: list[str] | None = None, all_reasons: bool = False) -> DataFrame:
        """Rows that break a rule ((name, condition) pairs), with the first or all names of broken rules."""
        reasons = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), F.lit(n)) for n, c in rules)))
        d = self.df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
        keep = ([id_col] if id_col else []) + list(columns_to_keep or [])
        return d.select(*(keep or self.df.columns), F.col("reasons") if all_reasons else F.get("reasons", F.lit(0)).alias("reason"))

    def _pairs(self, cols: list[str], f) -> DataFrame:
        pairs = list(itertools.product(cols, cols))
        one = self.df.agg(*(f(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
        return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))))

    def null_corr(self, subset: list[str] | None = None) -> DataFrame:
        nulls = lambda c: F.col(c).isNull().cast("double")
        return self._pairs(subset or self.df.columns, lambda a, b: ieee_div(F.covar_pop(nulls(a), nulls(b)), F.stddev_pop(nulls(a)) * F.stddev_pop(nulls(b))))

    def corr(self, subset: list[str] | None = None, method: str = "pearson") -> DataFrame:
        cols = subset or self.numerics
        if method == "pearson":
            return self._pairs(cols, stats.pearson)
        rows = [(a, b, stats.corr(self.df, a, b, method).first()[0]) for a, b in itertools.combinations(cols, 2)]
        return self.df.sparkSession.createDataFrame(rows, "x string, y string, corr double")

    def infer_corr(self, method: str = "pearson") -> DataFrame:
        return self.corr(method=method).filter("x < y").orderBy(F.desc(F.abs("corr")))

    def str_stats(self) -> DataFrame:
        per = {}
        for c in self.classes["strs"]:
            b, n = F.octet_length(c), F.char_length(c)
            per[c] = {"null_count": F.count_if(F.col(c).isNull()), "n_unique": F.count_distinct(c), "mode": F.mode(c, True), "min_byte_len": F.min(b), "max_byte_len": F.max(b), "avg_byte_len": F.avg(b), "min_char_len": F.min(n), "max_char_len": F.max(n), "avg_char_len": F.avg(n)}
        return self._rows(per)

    @cached_property
    def _counts(self) -> dict:
        """n, nulls and distinct values of each column, computed once."""
        row = self.df.agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.count_distinct(F.col(f"`{c}`")).alias("d")).alias(f"s{i}") for i, c in enumerate(self.df.columns))).first()
        return {"n": row.n, **{c: (row[f"s{i}"].n, row[f"s{i}"].d) for i, c in enumerate(self.df.columns)}}

    def infer_high_null(self, threshold: float = 0.75) -> list[str]:
        n = self._counts["n"]
        return [c for c in self.df.columns if n and (n - self._counts[c][0]) / n >= threshold]

    def infer_discrete(self, threshold: float = 0.1, max_val_cnt: int = 100) -> list[str]:
        n = self._counts["n"]
        return [c for c in self.df.columns if n and self._counts[c][1] / n < threshold and self._counts[c][1] <= max_val_cnt]

    def infer_k_distinct(self, k: int, include_null: bool = False) -> list[str]:
        n = self._counts["n"]
        return [c for c in self.df.columns if self._counts[c][1] + (include_null and self._counts[c][0] < n) == k]

    def infer_const(self, include_null: bool = False) -> list[str]:
        return self.infer_k_distinct(1, include_null)

    def infer_binary(self, include_null: bool = False) -> list[str]:
        return self.infer_k_distinct(2, include_null)

    def infer_prob(self) -> list[str]:
        cols = self.classes["floats"]
        if not cols:
            return []
        row = self.df.agg(*(F.bool_and(F.col(c).between(0.0, 1.0)).alias(c) for c in cols)).first()
        return [c for c in cols if row[c]]

    def infer_dependency(self, subset: list[str] | None = None) -> DataFrame:
        """(x, y, cond_entropy): H(x | y) of all pairs; near 0, y determines x."""
        cols = subset or self.infer_discrete()
        rows = [(a, b, query_cond_entropy(self.df, a, b).first()[0]) for a, b in itertools.permutations(cols, 2)]
        return self.df.sparkSession.createDataFrame(rows, "x string, y string, cond_entropy double")

    def plot_dependency(self, threshold: float = 0.01, subset: list[str] | None = None) -> DataFrame:
        """The edges of the dependency graph."""
        return self.infer_dependency(subset).filter(F.col("cond_entropy") < threshold)

    def plot_corr(self, subset: list[str] | None = None, method: str = "pearson") -> DataFrame:
        return self.corr(subset, method)

    def plot_feature_distr(self, feature: str, n_bins: int = 10, over: str | None = None) -> DataFrame:
        return feature_distr(self.df, feature, n_bins, over)


# --- the tables behind charts


def feature_distr(df: DataFrame, feature: str, n_bins: int = 10, over: str | None = None) -> DataFrame:
    x = finite(feature)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, width = r.lo or 0.0, ((r.hi - r.lo) / n_bins if r.hi is not None else 0) or 1.0
    by = [over] if over else []
    return df.filter(x.isNotNull()).groupBy(*by, F.least(F.floor((x - lo) / width), F.lit(n_bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count")).withColumns({"lower": F.lit(lo) + F.col("bin") * width, "upper": F.lit(lo) + (F.col("bin") + 1) * width})


def prob_calibration(df: DataFrame, target: str, score: str, n_bins: int = 10) -> DataFrame:
    b = F.least(F.floor(dbl(score) * n_bins), F.lit(n_bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.avg(dbl(score)).alias("mean_score"), F.avg(dbl(target)).alias("rate"), F.count(F.lit(1)).alias("count"))


def lin_reg_points(df: DataFrame, x: str, target: str, max_points: int = 20000, seed: int = 42) -> DataFrame:
    return misc.sample(df.select(x, target), max_points, seed=seed)


def pca_points(df: DataFrame, features: list[str], by: str, dim: int = 2, max_points: int = 10000, seed: int = 42) -> DataFrame:
    from ..operators.linear import principal_components

    return misc.sample(principal_components(df, *features, k=dim).select(by, *(f"pc{i + 1}" for i in range(dim))), max_points, seed=seed)
