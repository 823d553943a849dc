"""Running sums over a whole frame without one task that holds all of it.

Rows are dealt to ranges of the order column.  Each range sums its own rows in a window; what the ranges before it hold
is a second, small aggregate, a row a range.  Bounds of the ranges come from a bounded sample and only balance the work.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .col import finite, to_col

#: Ranges, at most (their bounds are literals of an expression), and rows of the sample for each.
RANGES, SAMPLED = 128, 16
#: Rows that one task may sort: a frame of no more is one window.
FEW = 50_000
#: Rows of a block of a series.
BLOCK_ROWS = 1 << 16


def _range_of(x: Column, bounds: list) -> Column:
    """Number of the range that x falls in: a tree of comparisons with the sorted bounds."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def range_column(df: DataFrame, x, ranges: int | None = None) -> Column:
    """The range of x, 0 to ``ranges`` - 1, in ascending order; -1 for nulls."""
    x = to_col(x)
    n = min(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES)
    rows = df.select(x.alias("x")).filter("x IS NOT NULL").orderBy(F.xxhash64("x"), "x").limit(n * SAMPLED).collect()
    values = sorted(r.x for r in rows if r.x == r.x and not (isinstance(r.x, float) and math.isinf(r.x)))
    bounds = sorted({values[i * len(values) // n] for i in range(1, n)}) if values else []
    return F.when(x.isNull(), F.lit(-1)).otherwise(_range_of(x, bounds))


def is_few(df: DataFrame) -> bool:
    """Whether one task may sort the frame."""
    return df.limit(FEW + 1).count() <= FEW


def running(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False, ties: list | None = None, few: bool | None = None) -> DataFrame:
    """``df`` with, for each (new name, column) of ``sums``, the column's sum over the rows up to this one in the order.

    ``ties`` order rows of equal ``order``; nulls stand where Spark sorts them.  With ``by``, sums run within groups, and
    a group is a window; without, the frame is dealt to ranges, unless it has FEW rows at most (``few``: whether it has, where that is known).
    """
    step = [F.desc(order) if descending else F.asc(order), *(ties or [])]
    if by or (is_few(df) if few is None else few):
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({new: F.sum(c).over(w) for new, c in sums.items()})
    taken = {c.lower() for c in df.columns} | {c.lower() for c in sums}
    at, offset_at = (_free(taken, n) for n in ("range_", "range_of_"))
    ranged = df.withColumn(at, range_column(df, order))
    names = {new: _free(taken, f"{new}_before_") for new in sums}
    each = ranged.groupBy(F.col(at).alias(offset_at)).agg(*(F.sum(c).alias(names[new]) for new, c in sums.items()))
    # a row a range: at most RANGES
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc(offset_at) if descending else F.asc(offset_at)).rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(offset_at, *(F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in names.values()))
    w = Window.partitionBy(at).orderBy(*step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumns({new: F.sum(c).over(w) for new, c in sums.items()})
    out = inner.join(F.broadcast(before), F.col(at) == F.col(offset_at))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(new) + F.col(names[new])).alias(new) for new in sums))


def numbered(df: DataFrame, order: str, name: str, by: list[str] | None = None, descending: bool = False, ties: list | None = None) -> DataFrame:
    """``df`` with the row's number in the order, from 1 on; as ``running``."""
    one = _free({c.lower() for c in df.columns} | {name.lower()}, "one_")
    return running(df.withColumn(one, F.lit(1).cast("long")), order, {name: one}, by, descending, ties).drop(one)


def with_totals(df: DataFrame, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with the sums of its groups, or of all of it, beside each row."""
    if by:
        return df.withColumns({new: F.sum(c).over(Window.partitionBy(*by)) for new, c in sums.items()})
    return df.crossJoin(F.broadcast(df.agg(*(F.sum(c).alias(new) for new, c in sums.items()))))  # one row


def exact_quantile(df: DataFrame, x, q: float) -> float | None:
    """The quantile of the finite values of x, linear between two of them, as ``percentile`` gives it; no task holds all values.

    Counts of distinct values are dealt to ranges; only the range that holds the place is looked into.
    """
    values = df.select(finite(x).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    n = values.agg(F.sum("n")).first()[0]
    if not n:
        return None
    at = q * (n - 1)
    lower, upper, before = math.floor(at), math.ceil(at), 0
    while True:
        part = range_column(values, "v", RANGES)
        rows = values.groupBy(part.alias("p")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("p").collect()
        i = 0
        while before + rows[i].n <= lower:
            before += rows[i].n
            i += 1
        r = rows[i]
        if upper >= before + r.n:  # the last value of one range, and the first of the next
            found = r.hi, rows[i + 1].lo
        elif r.d == 1:
            found = r.lo, r.lo
        else:
            values = values.filter(F.col("v").between(r.lo, r.hi))
            if r.d > FEW:
                continue
            ends, sorted_ = [], sorted(values.collect())
            for row in sorted_:
                before += row.n
                ends.append(before)
            found = tuple(sorted_[bisect.bisect_right(ends, k)].v for k in (lower, upper))
        return found[0] if found[0] == found[1] else (upper - at) * found[0] + (at - lower) * found[1]


def _free(taken: set[str], name: str) -> str:
    while name.lower() in taken:
        name = f"{name}_"
    taken.add(name.lower())
    return name


def in_blocks(df: DataFrame, order: list, context: int, rows: int | None = None, ahead: int = 0) -> tuple[DataFrame, str, str]:
    """One ordered series as blocks that a window can take: ``df`` with the block of each row, and whether the row is the block's own.

    Each block also has the ``context`` rows before it and the ``ahead`` rows after it, so that a window over the block that looks
    as far sees what a window over the whole series sees.  Keep the rows that are a block's own afterwards.
    """
    rows = max(rows or BLOCK_ROWS, context, ahead)
    taken = {c.lower() for c in df.columns}
    at, i, block, own = (_free(taken, n) for n in ("order_", "number_", "block_", "own_"))
    d = numbered(df.withColumn(at, to_col(order[0])), at, i, ties=[to_col(o) for o in order[1:]]).drop(at)
    mine, place = F.expr(f"(`{i}` - 1) div {rows}"), F.pmod(F.col(i) - 1, F.lit(rows))
    blocks = [mine]
    if context:
        blocks.append(F.when(place >= rows - context, mine + 1))
    if ahead:
        blocks.append(F.when(place < ahead, mine - 1))
    out = d.withColumn(block, F.explode(F.array_compact(F.array(*blocks)))).withColumn(own, F.col(block) == mine)
    return out.drop(i), block, own


def series(df: DataFrame, by: list[str], order_by, back: int = 0, ahead: int = 0) -> tuple[DataFrame, WindowSpec, Column]:
    """A frame, a window over it in the given order, and a condition that rows must meet once the window has been used.

    With ``by`` a group is a window.  Without, the window is a block (see ``in_blocks``), and may look ``back`` and ``ahead`` so far.
    """
    order = order_by if isinstance(order_by, list | tuple) else [order_by]
    if by:
        return df, Window.partitionBy(*by).orderBy(*(to_col(o) for o in order)), F.lit(True)
    d, block, own = in_blocks(df, list(order), back, ahead=ahead)
    return d, Window.partitionBy(block).orderBy(*(to_col(o) for o in order)), F.col(own)
