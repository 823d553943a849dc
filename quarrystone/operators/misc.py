"""Survival curves, combinations and products, sampling and splitting."""

from __future__ import annotations

import random as _random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core.col import dbl
from ..core.prefix import is_few, numbered, running, with_totals


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def query_kaplan_meier_prob(df: DataFrame, status, time_exit, by=None) -> DataFrame:
    """(t, prob): the survival curve.  Rows are summed by time first; the running product is a sum of logarithms."""
    by = _by(by)
    s = F.expr(status) if isinstance(status, str) else status
    c = df.select(*by, dbl(time_exit).alias("t"), s.cast("int").alias("d")).filter("t IS NOT NULL AND d IS NOT NULL").groupBy(*by, "t").agg(F.sum("d").cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n"))
    few = bool(by) or is_few(c)
    f = running(c, "t", {"at_risk": "n"}, by, descending=True, few=few).withColumn("p", 1 - F.col("d") / F.col("at_risk"))
    f = f.withColumn("gone_", (F.col("p") <= 0).cast("int")).withColumn("log_", F.when(F.col("p") > 0, F.log("p")).otherwise(0.0))
    f = running(f, "t", {"gone": "gone_", "log": "log_"}, by, few=few)
    return f.select(*by, "t", F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("log")).alias("prob"))


def product(df: DataFrame, s1: str, s2: str) -> DataFrame:
    """All pairs of two columns' values: the product is the result."""
    return df.select(F.col(s1).alias("a")).crossJoin(df.select(F.col(s2).alias("b"))).select(F.array("a", "b").alias("pair"))


#: Rows that become columns, at most.
MOST_COLUMNS = 2_000


def transpose(df: DataFrame, header: str, name: str = "column") -> DataFrame:
    """A row for each other column, with its name; a column for each row, called by its value of ``header``.  Columns of different types become text."""
    rows = df.select(header).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"{header} must name {MOST_COLUMNS} rows at most, each once")
    rest = [c for c in df.columns if c != header]
    kinds = {df.schema[c].dataType for c in rest}
    cells = df.select(header, *(F.col(f"`{c}`") if len(kinds) == 1 else F.col(f"`{c}`").cast("string").alias(c) for c in rest)).unpivot([header], rest, name, "cell_")
    return cells.groupBy(name).pivot(header, [r[0] for r in rows]).agg(F.first("cell_"))


def combinations(df: DataFrame, source: str, k: int, unique: bool = False, order_by=None) -> DataFrame:
    """All k-combinations of a column's values, in the given order (by value by default)."""
    d = df.select(source).distinct() if unique else df
    d = numbered(d, order_by or source, "i_", ties=[F.col(f"`{c}`") for c in d.columns]).select(F.col(source).alias("v_"), "i_")
    out = d.select(F.array("v_").alias("values"), F.col("i_").alias("last_"))
    for _ in range(k - 1):
        out = out.join(d, d["i_"] > out["last_"]).select(F.concat("values", F.array("v_")).alias("values"), F.col("i_").alias("last_"))
    return out.select("values")


#: Rows of a sample that one task may gather.
TOP_ROWS = 50_000


# --- sampling: rows are drawn by a hash of the seed and the row, so that reruns agree whatever the partitions


def _key(df: DataFrame, seed: int | None) -> Column:
    if seed is None:
        return F.rand()
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in df.columns))


def sample(df: DataFrame, value: int | float, replace: bool = False, seed: int | None = None) -> DataFrame:
    """Exactly n rows, or the share of rows; with replacement each row comes as often as it is drawn."""
    n = int(value) if isinstance(value, int) else None
    if replace:
        count = df.count()
        want = n if n is not None else round(count * value)
        rng = F.rand(seed) if seed is not None else F.rand()
        rows = numbered(df.withColumn("key_", _key(df, seed or 0)), "key_", "i_").drop("key_")
        draws = df.sparkSession.range(want).select((F.floor(rng * count) + 1).cast("long").alias("i_"))
        return draws.join(rows, "i_").drop("i_")
    if n is None:
        n = round(df.count() * value)
    if n <= TOP_ROWS:
        return df.orderBy(_key(df, seed)).limit(n)
    # too many for one task to hold: the greatest key that is drawn is found by counts, and no row is sorted
    if df.count() <= n:
        return df
    keyed = df.withColumn("key_", _key(df, _random.randrange(1 << 31) if seed is None else seed))
    open_, left, drawn = keyed, n, None
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key_", shift)
        # 2 ** 16 counts at most
        counts = sorted((r.p, r.n) for r in open_.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        at = 0
        while counts[at][1] <= left and at + 1 < len(counts):
            left -= counts[at][1]
            at += 1
        cut, here = counts[at]
        below = open_.filter(part < cut)
        drawn = below if drawn is None else drawn.unionByName(below)
        open_ = open_.filter(part == cut)
        if here <= TOP_ROWS:
            break
    # rows of one key are copies of each other
    return drawn.unionByName(open_.orderBy("key_").limit(left) if here <= TOP_ROWS else open_.limit(left)).drop("key_")


def volume_neutral(df: DataFrame, by: str, control=None, target_volume: int | None = None, seed: int | None = None) -> DataFrame:
    """As many rows of each value of ``by`` (within each control group) as the smallest has, or target_volume."""
    control = _by(control)
    counts = df.groupBy(*control, by).count()
    least = counts.groupBy(*control).agg(F.min("count").alias("least_"))
    d = df.withColumn("i_", F.row_number().over(Window.partitionBy(*control, by).orderBy(_key(df, seed))))
    d = d.join(least, control) if control else d.crossJoin(F.broadcast(least))  # one row
    limit = F.least(F.col("least_"), F.lit(target_volume)) if target_volume else F.col("least_")
    return d.filter(F.col("i_") <= limit).select(*df.columns)


def downsample(df: DataFrame, conditions, seed: int | None = None) -> DataFrame:
    """Of the rows that meet a condition only a number or share stays; all others stay.  ``conditions``: (condition, value) or a list of them."""
    conditions = [conditions] if isinstance(conditions, tuple) else list(conditions)
    tests = [F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for c, _ in conditions]
    rest = df.filter(~reduce(lambda a, b: a | b, tests))
    parts, before = [], F.lit(False)
    for t, (_, value) in zip(tests, conditions):
        parts.append(sample(df.filter(t & ~before), value, seed=seed))
        before = before | t
    return reduce(DataFrame.unionByName, [rest, *parts])


def random_cols(all_columns: list[str], k: int, keep: list[str] | None = None, seed: int | None = None) -> list[str]:
    keep = list(keep or [])
    rest = [c for c in all_columns if c not in keep]
    if k > len(rest):
        raise ValueError("k is greater than the number of columns to choose from")
    return keep + _random.Random(seed).sample(rest, k)


def split_by_ratio(df: DataFrame, split_ratio, split_col: str = "__split", by=None, default_split_1: str = "train", default_split_2: str = "test", seed: int | None = None) -> DataFrame:
    """The frame with a split label; ``split_ratio``: a number, a list (split_0, ...), or a dict of shares; by: within each stratum."""
    by = _by(by)
    if isinstance(split_ratio, float):
        ratios = {default_split_1: split_ratio, default_split_2: 1 - split_ratio}
    elif isinstance(split_ratio, dict):
        ratios = dict(split_ratio)
    else:
        ratios = {f"split_{i}": r for i, r in enumerate(split_ratio)}
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    d = df.withColumn("key_", _key(df, _random.randrange(1 << 31) if seed is None else seed)).withColumn("one_", F.lit(1).cast("long"))
    d = with_totals(running(d, "key_", {"i_": "one_"}, by), {"n_": "one_"}, by).withColumn("pos_", (F.col("i_") - 1) / F.col("n_"))
    upto, label = 0.0, None
    for name, r in list(ratios.items())[:-1]:
        upto += r
        label = (F if label is None else label).when(F.col("pos_") < upto - 1e-12, F.lit(name))
    last = list(ratios)[-1]
    return d.withColumn(split_col, F.lit(last) if label is None else label.otherwise(F.lit(last))).drop("pos_", "key_", "one_", "i_", "n_")


def frame(spark: SparkSession, size: int = 2000, index_name: str = "row_num") -> DataFrame:
    return spark.range(size).withColumnRenamed("id", index_name)
