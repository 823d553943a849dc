"""A builder of feature pipelines, and the fitted pipeline: steps that are data, lazily applied to any frame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import transforms
from .windows import dynamic_groups


def _sql(c: str | Column) -> str:
    """SQL text of an expression with its alias; Python functions have none."""
    if isinstance(c, str):
        return c
    text = c._jc.toString() if hasattr(c, "_jc") else str(c)
    if "PythonUDF" in text or "pythonUDF" in text:
        raise ValueError("a Python function can't be stored")
    node = c._jc.node() if hasattr(c._jc, "node") else None
    return _render(c) if node is not None else text


def _render(c: Column) -> str:
    spark = SparkSession.active()
    expression = spark._jsparkSession.converter().apply(c._jc.node())
    return expression.sql()


@dataclass
class Step:
    """``kind``: select, with, filter, sql, sort, group, dynamic, explode, drop, rename, join; the rest are its arguments, as text."""

    kind: str
    args: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        a = self.args
        if self.kind == "select":
            return df.select(*(F.expr(e) for e in a["exprs"]))
        if self.kind == "with":
            # one projection: expressions replace a column of their name or follow
            out = {e["name"]: F.expr(e["sql"]) for e in a["exprs"]}
            return df.withColumns(out)
        if self.kind == "filter":
            return df.filter(F.expr(a["by"]))
        if self.kind == "sql":
            # the statement names the frame "df"
            return df.sparkSession.sql(a["sql"].replace("{", "{{").replace("}", "}}"), df=df) if "{df}" in a["sql"] else _with_view(df, a["sql"])
        if self.kind == "sort":
            return df.orderBy(*((F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_first()) for c, d in zip(a["by"], a["descending"])))
        if self.kind == "group":
            return df.groupBy(*a["by"]).agg(*(F.expr(e["sql"]).alias(e["name"]) for e in a["agg"]))
        if self.kind == "dynamic":
            return dynamic_groups(df, a["index_column"], [F.expr(e["sql"]).alias(e["name"]) for e in a["agg"]], **a["options"])
        if self.kind == "explode":
            cols = a["columns"]
            z = df.withColumn("z_", F.explode_outer(F.arrays_zip(*cols)))
            return z.select(*(F.col(f"z_.{c}").alias(c) if c in cols else F.col(c) for c in df.columns))
        if self.kind == "drop":
            return df.drop(*a["cols"])
        if self.kind == "rename":
            return df.withColumnsRenamed(a["mapping"])
        if self.kind == "join":
            return transforms.Joined(**a).apply(df)
        raise ValueError(self.kind)


def _with_view(df: DataFrame, sql: str) -> DataFrame:
    df.createOrReplaceTempView("df")
    try:
        return df.sparkSession.sql(sql)
    finally:
        df.sparkSession.catalog.dropTempView("df")


@dataclass
class FitStep:
    """Becomes an expression step when the blueprint is materialised."""

    func: Callable
    cols: list[str] | None
    kwargs: dict
    kind: str = "with"
    drop: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> list[Step]:
        exprs = self.func(df, self.cols, **self.kwargs) if self.cols is not None else self.func(df, **self.kwargs)
        joins = [Step("join", asdict(e)) for e in exprs if isinstance(e, transforms.Joined)]
        exprs = [e for e in exprs if not isinstance(e, transforms.Joined)]
        step = Step("select", {"exprs": [_sql(e) for e in exprs]}) if self.kind == "select" else Step("with", {"exprs": [_named(e) for e in exprs]})
        return [step, *joins] + ([Step("drop", {"cols": self.drop})] if self.drop else [])


def _named(e: str | Column) -> dict:
    """The name and the SQL of an aliased expression."""
    c = F.expr(e) if isinstance(e, str) else e
    spark = SparkSession.active()
    x = spark._jsparkSession.converter().apply(c._jc.node())
    if x.getClass().getSimpleName() == "Alias":
        return {"name": x.name(), "sql": x.child().sql()}
    text = x.sql()
    return {"name": text.strip("`"), "sql": text}


def _cols(df: DataFrame, cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


@dataclass
class Pipeline:
    name: str
    target: str | None
    feature_names_in_: list[str]
    feature_names_out_: list[str]
    steps: list[Step]
    ensure_features_in: bool = False
    ensure_features_out: bool = True
    lowercase: bool = False
    uppercase: bool = False

    def __str__(self) -> str:
        return f"Pipeline {self.name}: " + ", ".join(s.kind for s in self.steps)

    def with_features_out(self, features: list[str], ensure_features_out: bool = True) -> Pipeline:
        self.feature_names_out_, self.ensure_features_out = list(features), ensure_features_out
        return self

    def ensure_features_io(self, ensure_in: bool = True, ensure_out: bool = True) -> Pipeline:
        self.ensure_features_in, self.ensure_features_out = ensure_in, ensure_out
        return self

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps({**{k: v for k, v in self.__dict__.items() if k != "steps"}, "steps": [{"kind": s.kind, "args": s.args} for s in self.steps]})
        if path:
            with open(path, "w") as f:
                f.write(text)
        return text

    @classmethod
    def from_json(cls, json_str: str) -> Pipeline:
        d = json.loads(json_str)
        return cls(**{**d, "steps": [Step(**s) for s in d["steps"]]})

    def transform(self, df: DataFrame, set_features_out: bool = False) -> DataFrame:
        df = _cased(df, self.lowercase, self.uppercase)
        if self.ensure_features_in and (missing := set(self.feature_names_in_) - set(df.columns)):
            raise ValueError(f"missing: {sorted(missing)}")
        for s in self.steps:
            df = s.apply(df)
        if set_features_out:
            self.feature_names_out_ = df.columns
        return df.select(*(f"`{c}`" for c in self.feature_names_out_ if c in df.columns)) if self.ensure_features_out and self.feature_names_out_ else df


def _cased(df: DataFrame, lower: bool, upper: bool) -> DataFrame:
    return df.toDF(*(c.lower() if lower else c.upper() for c in df.columns)) if lower or upper else df


class Blueprint:
    """Collects steps; ``materialize`` fits those that need it, in order, and gives the Pipeline."""

    def __init__(self, df: DataFrame, name: str = "test", target: str | None = None, exclude: list[str] | None = None, lowercase: bool = False, uppercase: bool = False) -> None:
        self.df, self.name, self.target, self.exclude = _cased(df, lowercase, uppercase), name, target, list(exclude or [])
        self.lowercase, self.uppercase = lowercase, uppercase
        self.feature_names_in_ = self.df.columns
        self.steps: list[Step | FitStep] = []

    def __str__(self) -> str:
        return f"Blueprint {self.name}: " + ", ".join(s.kind if isinstance(s, Step) else s.func.__name__ for s in self.steps)

    def _get_target(self, target: str | None = None) -> str:
        t = target or self.target
        if t is None:
            raise ValueError("no target")
        return t

    def _add(self, kind: str, **args) -> Blueprint:
        self.steps.append(Step(kind, args))
        return self

    def _fit(self, func: Callable, cols, *, kind: str = "with", drop: list[str] | None = None, **kwargs) -> Blueprint:
        cols = None if cols is None else [c for c in _cols(self.df, cols) if c not in self.exclude]
        self.steps.append(FitStep(func, cols, kwargs, kind, drop or []))
        return self

    def filter(self, by: str | Column) -> Blueprint:
        return self._add("filter", by=_sql(by))

    def sql_transform(self, sql: str) -> Blueprint:
        return self._add("sql", sql=sql)

    def cast_bools(self, dtype: str = "tinyint") -> Blueprint:
        def cast(df: DataFrame) -> list[Column]:
            return [F.col(f.name).cast(dtype).alias(f.name) for f in df.schema if isinstance(f.dataType, T.BooleanType)]

        return self._fit(cast, None)

    def nan_to_null(self) -> Blueprint:
        def change(df: DataFrame) -> list[Column]:
            return [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]

        return self._fit(change, None)

    def int_to_float(self, f32: bool = True) -> Blueprint:
        def change(df: DataFrame) -> list[Column]:
            return [F.col(f.name).cast("float" if f32 else "double").alias(f.name) for f in df.schema if isinstance(f.dataType, T.IntegralType)]

        return self._fit(change, None)

    def impute(self, cols, method: str = "mean") -> Blueprint:
        return self._fit(transforms.impute, cols, method=method)

    def conditional_impute(self, rules_dict: dict, method: str = "mean") -> Blueprint:
        return self._fit(transforms.conditional_impute, None, rules_dict=rules_dict, method=method)

    def linear_impute(self, features, target: str | None = None, add_bias: bool = False) -> Blueprint:
        return self._fit(transforms.linear_impute, features, target=self._get_target(target), add_bias=add_bias)

    def scale(self, cols, method: str = "standard") -> Blueprint:
        return self._fit(transforms.scale, cols, method=method)

    def robust_scale(self, cols, q_low: float = 0.25, q_high: float = 0.75) -> Blueprint:
        return self._fit(transforms.robust_scale, cols, q_low=q_low, q_high=q_high)

    def center(self, cols) -> Blueprint:
        return self._fit(transforms.center, cols)

    def select(self, *cols) -> Blueprint:
        return self._add("select", exprs=[f"`{c}`" if isinstance(c, str) and c in self.df.columns else _sql(c) for c in cols])

    def select_by_std(self, min_: float, max_: float) -> Blueprint:
        def pick(df: DataFrame) -> list[Column]:
            return transforms.select_by_std(df, [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in self.exclude], min_, max_)

        return self._fit(pick, None, kind="select")

    def polynomial_features(self, cols, degree: int, interaction_only: bool = True) -> Blueprint:
        return self.with_columns(*transforms.polynomial_features(_cols(self.df, cols), degree, interaction_only))

    def winsorize(self, cols, q_low: float = 0.05, q_high: float = 0.95, method: str = "nearest") -> Blueprint:
        return self._fit(transforms.winsorize, cols, q_low=q_low, q_high=q_high, method=method)

    def drop(self, cols) -> Blueprint:
        return self._add("drop", cols=_cols(self.df, cols))

    def rename(self, rename_dict: dict[str, str]) -> Blueprint:
        return self._add("rename", mapping=rename_dict)

    def one_hot_encode(self, cols=None, separator: str = "_", drop_first: bool = False, drop_cols: bool = True) -> Blueprint:
        cols = _strings(self.df) if cols is None else _cols(self.df, cols)
        return self._fit(transforms.one_hot_encode, cols, drop=cols if drop_cols else [], separator=separator, drop_first=drop_first)

    def ordinal_encode(self, cols=None, unknown_value: float | None = None, null_value: float | None = None) -> Blueprint:
        return self._fit(transforms.ordinal_encode, _strings(self.df) if cols is None else cols, unknown_value=unknown_value, null_value=null_value)

    def rank_hot_encode(self, col: str, ranking: list[str], default_rank: int | None = None, drop_cols: bool = True) -> Blueprint:
        self.with_columns(*transforms.rank_hot_encode(col, ranking, default_rank))
        return self.drop([col]) if drop_cols else self

    def target_encode(self, cols=None, target: str | None = None, min_samples_leaf: int = 20, smoothing: float = 10.0, default=None) -> Blueprint:
        return self._fit(transforms.target_encode, _strings(self.df) if cols is None else cols, target=self._get_target(target), min_samples_leaf=min_samples_leaf, smoothing=smoothing, default=default, joined=True)

    def woe_encode(self, cols=None, target: str | None = None, default=None) -> Blueprint:
        return self._fit(transforms.woe_encode, _strings(self.df) if cols is None else cols, target=self._get_target(target), default=default, joined=True)

    def iv_encode(self, cols=None, target: str | None = None, default=None) -> Blueprint:
        return self._fit(transforms.iv_encode, _strings(self.df) if cols is None else cols, target=self._get_target(target), default=default, joined=True)

    def with_columns(self, *exprs) -> Blueprint:
        return self._add("with", exprs=[_named(e) for e in exprs])

    def sort(self, by, descending: bool | list[bool] = False) -> Blueprint:
        by = _cols(self.df, by)
        return self._add("sort", by=by, descending=[descending] * len(by) if isinstance(descending, bool) else list(descending))

    def explode(self, columns) -> Blueprint:
        return self._add("explode", columns=_cols(self.df, columns))

    def group_by_agg(self, by, agg: list) -> Blueprint:
        return self._add("group", by=_cols(self.df, by), agg=[_named(e) for e in agg])

    def group_by_dynamic_agg(self, index_column: str, agg: list, every: str, period: str | None = None, offset: str | None = None, include_boundaries: bool = False, closed: str = "left", label: str = "left", group_by=None, start_by: str = "window") -> Blueprint:
        options = {"every": every, "period": period, "offset": offset, "include_boundaries": include_boundaries, "closed": closed, "label": label, "group_by": None if group_by is None else _cols(self.df, group_by), "start_by": start_by}
        return self._add("dynamic", index_column=index_column, agg=[_named(e) for e in agg], options=options)

    def append_fit_func(self, func: Callable, cols, **kwargs) -> Blueprint:
        return self._fit(func, cols, **kwargs)

    def append_step_from_dict(self, dictionary: dict) -> Blueprint:
        return getattr(self, dictionary["name"])(*dictionary.get("args", []), **dictionary.get("kwargs", {}))

    def materialize(self, return_df: bool = False):
        df, done = self.df, []
        for s in self.steps:
            steps = s.fit(df) if isinstance(s, FitStep) else [s]
            for x in steps:
                if x.args.get("exprs") != []:
                    df = x.apply(df)
                    done.append(x)
        pipe = Pipeline(self.name, self.target, list(self.feature_names_in_), df.columns, done, lowercase=self.lowercase, uppercase=self.uppercase)
        return (pipe, df) if return_df else pipe

    def fit(self, X=None, y=None) -> Pipeline:
        return self.materialize()

    def transform(self, df: DataFrame) -> DataFrame:
        return self.materialize().transform(df)


__all__ = ["Blueprint", "Pipeline", "Step", "FitStep"]
