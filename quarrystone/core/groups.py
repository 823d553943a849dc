"""Kernels over ordered groups: a Python call takes the rows of many groups, so that small groups cost no call each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .col import dbl, to_col

#: Rows of a batch of results.
OUT_ROWS = 1 << 16


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def same_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size that occurs: it, the numbers of the groups, and their rows (a row of the matrix a group)."""
    first = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, first[at][:, None] + np.arange(n)


def one_by_one(f: Callable) -> Callable:
    """A kernel of many groups from one of a group that gives a number or arrays of equal length."""

    def run(sizes: np.ndarray, *columns: np.ndarray):
        cuts = np.cumsum(sizes)[:-1]
        out = [f(*parts) for parts in zip(*(np.split(c, cuts) for c in columns))]
        if out and not isinstance(out[0], tuple):
            return np.ones(len(out), np.int64), np.array(out, float)
        return np.array([len(o[0]) for o in out], np.int64), *(np.concatenate(c) for c in zip(*out))

    return run


def kernel(df: DataFrame, cols: list, order_by, by: list[str], f: Callable, kind: str) -> DataFrame:
    """``f(sizes, *columns)`` of the groups' sizes and their rows, one group after the other in order, to the sizes of
    its results and columns of ``kind``.  A group's rows are never parted; a task reads its groups as a stream."""
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    slim = df.select(*by, *(to_col(o).alias(f"o{i}_") for i, o in enumerate(order)), *(dbl(c).alias(f"c{i}_") for i, c in enumerate(cols)))
    w = Window.partitionBy(*by).orderBy(*(F.asc_nulls_last(f"o{i}_") for i in range(len(order)))) if order else Window.partitionBy(*by).orderBy(F.lit(0))
    # the window deals and sorts the rows; 1 begins a group
    d = slim.withColumn("place_", F.row_number().over(w)).select(*(F.col(f"`{b}`") for b in by), *(f"c{i}_" for i in range(len(cols))), "place_")
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, sizes in whole(batches):
            sizes, *out = f(sizes, *(t.column(f"c{i}_").to_numpy() for i in range(len(cols))))
            keys = t.select(range(len(by))).take(pa.array(np.repeat(first, sizes)))
            yield from pa.table([*keys.columns, *(pa.array(c) for c in out)], names=[*by, *names]).to_batches(OUT_ROWS)

    return d.mapInArrow(run, ", ".join([*(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by), kind]))


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups with their first rows and sizes, from batches whose column ``place_`` is 1 where a group begins."""

    def table(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(t.column("place_").to_numpy() == 1)
        return t, first, np.diff(np.append(first, t.num_rows))

    held: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(b.column(b.schema.get_field_index("place_")).to_numpy() == 1)
        if len(begins) and held:
            cut = int(begins[-1])
            yield table([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif b.num_rows:
            held.append(b)
    if held:
        yield table(held)
