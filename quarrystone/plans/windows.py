"""Tumbling and sliding windows over a time or an integer index, with closed ends and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_MONTHS = {"mo": 1, "q": 3, "y": 12}


def parse(text: str) -> tuple[str, float]:
    """("seconds" or "months" or "rows", amount) of a duration such as 1h30m, 1mo or 5i."""
    total, kind = 0.0, None
    for n, unit in re.findall(r"(-?\d+)(ns|us|ms|mo|[smhdwqyi])", text):
        k = "rows" if unit == "i" else "months" if unit in _MONTHS else "seconds"
        if kind not in (None, k):
            raise ValueError(f"mixed units: {text}")
        kind, total = k, total + int(n) * (1 if k == "rows" else _MONTHS.get(unit) or _SECONDS[unit])
    if kind is None:
        raise ValueError(text)
    return kind, total


def dynamic_groups(df: DataFrame, index_column: str, agg: list[Column], every: str, period: str | None = None, offset: str | None = None, include_boundaries: bool = False, closed: str = "left", label: str = "left", group_by: list[str] | None = None, start_by: str = "window") -> DataFrame:
    """A row for each window with rows: its label in the index column, the boundaries if asked for, the aggregates.

    Windows begin at multiples of ``every`` plus ``offset`` (start_by "window") or at the first value ("datapoint").
    Each row goes, by arithmetic on its index, to every window that covers it: no join, one aggregation.
    """
    group_by = list(group_by or [])
    (kind, step), (_, length) = parse(every), parse(period or every)
    shift = parse(offset)[1] if offset else 0.0
    is_time = not isinstance(df.schema[index_column].dataType, T.IntegralType)
    t = F.col(index_column)
    if kind == "months":
        # months since year 0, with the moment inside the month as its fraction for the closed ends
        x = (F.year(t) * 12 + F.month(t) - 1).cast("double")
        inside = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("month", t.cast("timestamp")))
        x = x + F.when(inside > 0, F.lit(0.5)).otherwise(0.0)
    elif is_time:
        x = F.unix_micros(t.cast("timestamp")) / 1e6
    else:
        x = t.cast("double")
    if start_by == "datapoint":
        shift = df.agg(F.min(x).alias("m")).first().m or 0.0
    # weeks begin on Mondays
    elif kind == "seconds" and every.endswith("w"):
        shift += 4 * 86400
    rel = x - shift
    left_in, right_in = closed in ("left", "both"), closed in ("right", "both")
    hi = F.floor(rel / step) if left_in else F.ceil(rel / step) - 1
    lo = F.ceil((rel - length) / step) if right_in else F.floor((rel - length) / step) + 1
    d = df.withColumn("k_", F.explode(F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))))

    def back(v: Column) -> Column:
        if kind == "months":
            whole = v.cast("long")
            return F.make_timestamp(F.floor(whole / 12).cast("int"), (whole % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast(df.schema[index_column].dataType)
        return F.timestamp_micros(F.round(v * 1e6).cast("long")).cast(df.schema[index_column].dataType) if is_time else v.cast(df.schema[index_column].dataType)

    low = F.col("k_") * step + shift
    labels = {"left": back(low), "right": back(low + length), "datapoint": F.col("first_")}
    out = d.groupBy(*group_by, "k_").agg(F.min(t).alias("first_"), *agg)
    names = [c for c in out.columns if c not in (*group_by, "k_", "first_")]
    bounds = [back(low).alias("_lower_boundary"), back(low + length).alias("_upper_boundary")] if include_boundaries else []
    return out.select(*group_by, *bounds, labels[label].alias(index_column), *names)
