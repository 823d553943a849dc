"""Transforms that are fitted once and become expressions: statistics turn into literals."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.col import dbl, finite, quantile, total
from ..operators import encode
from ..operators.linear import lin_reg


def _stat(c: Column, method: str) -> Column:
    return {"mean": F.avg, "median": F.median, "mode": F.mode}[method](c)


def impute(df: DataFrame, cols: list[str], method: str = "mean") -> list[Column]:
    row = df.agg(*(_stat(F.col(c), method).alias(c) for c in cols)).first()
    return [F.coalesce(F.col(c), F.lit(row[c])).alias(c) for c in cols]


def conditional_impute(df: DataFrame, rules_dict: dict[str, str | Column], method: str = "mean") -> list[Column]:
    rule = {c: F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(True)) for c, r in rules_dict.items()}
    row = df.agg(*(_stat(F.when(~r, F.col(c)), method).alias(c) for c, r in rule.items())).first()
    return [F.when(r, F.lit(row[c])).otherwise(F.col(c)).alias(c) for c, r in rule.items()]


def linear_impute(df: DataFrame, features: list[str], target: str, add_bias: bool = False) -> list[Column]:
    b = lin_reg(df, *features, target=target, add_bias=add_bias).first().coeffs
    return [F.coalesce(F.col(target), total([*(float(w) * dbl(f) for w, f in zip(b, features)), F.lit(float(b[-1]) if add_bias else 0.0)])).alias(target)]


def center(df: DataFrame, cols: list[str]) -> list[Column]:
    row = df.agg(*(F.avg(c).alias(c) for c in cols)).first()
    return [(F.col(c) - F.lit(row[c])).alias(c) for c in cols]


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> list[Column]:
    """standard (population deviation), min_max or abs_max; columns without spread stay as they are."""
    if method == "standard":
        row = df.agg(*(F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"b{i}") for i, c in enumerate(cols))).first()
    elif method == "min_max":
        row = df.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(cols)), *((F.max(c) - F.min(c)).alias(f"b{i}") for i, c in enumerate(cols))).first()
    else:
        row = df.agg(*(F.lit(0.0).alias(f"a{i}") for i, _ in enumerate(cols)), *(F.max(F.abs(c)).alias(f"b{i}") for i, c in enumerate(cols))).first()
    return [((F.col(c) - F.lit(row[f"a{i}"])) / F.lit(float(row[f"b{i}"]))).alias(c) for i, c in enumerate(cols) if row[f"b{i}"]]


def robust_scale(df: DataFrame, cols: list[str], q_low: float = 0.25, q_high: float = 0.75, method: str = "midpoint") -> list[Column]:
    row = df.agg(*(quantile(c, q_low, method).alias(f"a{i}") for i, c in enumerate(cols)), *(quantile(c, q_high, method).alias(f"b{i}") for i, c in enumerate(cols))).first()
    return [((F.col(c) - row[f"a{i}"]) / (row[f"b{i}"] - row[f"a{i}"])).alias(c) for i, c in enumerate(cols) if row[f"b{i}"] != row[f"a{i}"]]


def winsorize(df: DataFrame, cols: list[str], q_low: float = 0.05, q_high: float = 0.95, method: str = "nearest") -> list[Column]:
    row = df.agg(*(quantile(c, q_low, method).alias(f"a{i}") for i, c in enumerate(cols)), *(quantile(c, q_high, method).alias(f"b{i}") for i, c in enumerate(cols))).first()
    return [F.when(F.col(c) < row[f"a{i}"], row[f"a{i}"]).when(F.col(c) > row[f"b{i}"], row[f"b{i}"]).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)]


#: Distinct values of an encoded column, at most: beyond it, a table joined by value is the way, not literals.
MAX_LITERALS = 10_000


def _values(df: DataFrame, c: str) -> list:
    rows = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(MAX_LITERALS + 1).collect()
    if len(rows) > MAX_LITERALS:
        raise ValueError(f"{c} has more than {MAX_LITERALS} distinct values")
    return sorted(r[0] for r in rows)


def one_hot_encode(df: DataFrame, cols: list[str], separator: str = "_", drop_first: bool = False) -> list[Column]:
    out = []
    for c in cols:
        values = _values(df, c)
        if len(values) > 1:
            out += [F.col(c).eqNullSafe(F.lit(v)).cast("tinyint").alias(f"{c}{separator}{v}") for v in values[int(drop_first) :]]
    return out


def lookup(c: str, mapping: dict, default: Column | None = None, null: Column | None = None) -> Column:
    """The value mapped to; ``default`` for values not mapped."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
    found = F.try_element_at(pairs, F.col(c)) if pairs is not None else F.lit(None).cast("double")
    return F.when(F.col(c).isNull(), F.lit(None).cast("double") if null is None else null).otherwise(found if default is None else F.coalesce(found, default))


def ordinal_encode(df: DataFrame, cols: list[str], unknown_value: float | None = None, null_value: float | None = None) -> list[Column]:
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    return [lookup(c, {v: float(i) for i, v in enumerate(_values(df, c))}, lit(unknown_value), lit(null_value)).alias(c) for c in cols]


def rank_hot_encode(col: str, ranking: list[str], default_rank: int | None = None) -> list[Column]:
    rank = lookup(col, {v: float(i) for i, v in enumerate(ranking)}, F.lit(None if default_rank is None else float(default_rank)).cast("double"))
    return [(rank >= i).cast("tinyint").alias(f"{col}>={ranking[i]}") for i in range(1, len(ranking))]


@dataclass
class Joined:
    """An encoding with more values than literals are used for: a table joined by value.  Values are kept as text with their type."""

    name: str
    kind: str
    values: list[str]
    codes: list[float | None]
    default: float | None

    def table(self, spark: SparkSession) -> DataFrame:
        text = spark.createDataFrame(list(zip(self.values, self.codes)), "v_ string, code_ double")
        return text.select((F.unbase64("v_") if self.kind == "binary" else F.col("v_").cast(self.kind)).alias("v_"), "code_")

    def column(self, spark: SparkSession) -> Column:
        # values are distinct: max is the one code
        found = self.table(spark).where(F.col("v_") == F.col(self.name).outer()).select(F.max("code_")).scalar()
        return self._or_default(F.col(self.name), found).alias(self.name)

    def apply(self, df: DataFrame) -> DataFrame:
        table = self.table(df.sparkSession)
        out = df.join(table, df[self.name] == table["v_"], "left")
        return out.select(*(self._or_default(df[c], table["code_"]).alias(c) if c == self.name else df[f"`{c}`"] for c in df.columns))

    def _or_default(self, value: Column, code: Column) -> Column:
        return F.when(value.isNotNull(), F.coalesce(code, F.lit(self.default).cast("double")))


def _encoded(c: str, table: DataFrame, default: str | float | None, joined: bool) -> Column | Joined:
    rows = table.limit(MAX_LITERALS + 1).collect()
    large = len(rows) > MAX_LITERALS
    if large:
        value, code = table.columns
        kind = table.schema[value].dataType.simpleString()
        rows = table.select(F.base64(value) if kind == "binary" else F.col(value).cast("string"), code).collect()
    m = {r[0]: None if r[1] is None else float(r[1]) for r in rows}
    d = {"null": None, "zero": 0.0, "mean": sum(m.values()) / len(m) if m and default == "mean" else None}.get(default, default) if isinstance(default, str) else default
    if large:
        j = Joined(c, kind, list(m), list(m.values()), None if d is None else float(d))
        return j if joined else j.column(table.sparkSession)
    return lookup(c, m, F.lit(d).cast("double")).alias(c)


# joined: encodings of more than MAX_LITERALS values come as Joined instead of as expressions with a subquery, which can't be stored

def target_encode(df: DataFrame, cols: list[str], /, target: str, min_samples_leaf: int = 20, smoothing: float = 10.0, default: str | float | None = "null", joined: bool = False) -> list[Column | Joined]:
    return [_encoded(c, encode.target_encode(df, c, target, min_samples_leaf, smoothing), default, joined) for c in cols]


def woe_encode(df: DataFrame, cols: list[str], /, target: str, default: str | float | None = "null", joined: bool = False) -> list[Column | Joined]:
    return [_encoded(c, encode.woe_discrete(df, c, target), default, joined) for c in cols]


def iv_encode(df: DataFrame, cols: list[str], /, target: str, default: str | float | None = "null", joined: bool = False) -> list[Column | Joined]:
    return [_encoded(c, encode.info_value_discrete(df, c, target, False), default, joined) for c in cols]


def select_by_std(df: DataFrame, cols: list[str], /, min_: float, max_: float) -> list[Column]:
    """All columns but the numeric ones whose deviation is outside [min_, max_]."""
    row = df.agg(*(F.stddev_samp(finite(c)).alias(c) for c in cols)).first()
    drop = {c for c in cols if row[c] is None or not min_ <= row[c] <= max_}
    return [F.col(f"`{c}`") for c in df.columns if c not in drop]


def polynomial_features(cols: list[str], /, degree: int, interaction_only: bool = False) -> list[Column]:
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    out = []
    for c in pick(cols, degree):
        e = F.col(c[0])
        for x in c[1:]:
            e = e * F.col(x)
        out.append(e.alias("*".join(c)))
    return out
