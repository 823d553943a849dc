"""What several operators share: shared-folder staging, and hashing of words with numpy."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker looks at together (a longer single text is taken alone).
SLICE_BYTES = 1_000_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one that was set for checkpoints.

    Where neither is set, only a session whose driver and executors are one process (local mode) goes on, in its warehouse folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarrystone/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: the cluster's own clean-up has to do it
            return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _where[id(out)] = (out, path)
    return out


_where: dict[int, tuple[DataFrame, str]] = {}


def free(*tables: DataFrame | None) -> None:
    """Removes tables that ``stage`` wrote, once nothing lazy reads them any more; others are left alone."""
    for df in tables:
        if df is not None and (held := _where.pop(id(df), None)):
            spark, path = df.sparkSession, held[1]
            remove(spark, path)
            _made.remove((spark, path))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACES}+"), "")


# --- numpy: hashes of all words of many texts at once -------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C55)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def table_of(separators: bytes | list[int]) -> np.ndarray:
    """Bytes that are part of a word."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


WORD_BYTES = table_of(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _R, np.uint64))])
            _inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _R_INV, np.uint64))])


def forget_powers() -> None:
    """Frees what ``span_hashes`` keeps for the longest slice so far; it grows again when needed."""
    global _powers, _inverse
    _powers = _inverse = np.ones(1, np.uint64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column, and where each begins and the last ends; null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each text (one entry more than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    w = inside[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = w.copy()
    begins[1:] &= ~w[:-1] | cut[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | cut[1:-1]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return b, e, np.searchsorted(b, at)


def span_hashes(raw: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(b):
        return np.zeros(0, np.uint64)
    _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=sums[1:])
        return mix((sums[e] - sums[b]) * _inverse[b] + (e - b).astype(np.uint64))


def shingle_hashes(words_: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``k`` words in a row, text by text, and the number of shingles before each text.

    A text of fewer than ``k`` words, but one at least, has one shingle of all its words.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(counts)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    start = np.repeat(first[:-1] - before[:-1], counts) + np.arange(before[-1])
    span = np.repeat(np.minimum(n, k), counts)
    h = np.zeros(before[-1], np.uint64)
    padded = np.concatenate([words_, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(k):
            h = np.where(i < span, h * np.uint64(0xD6E8FEB86659FD93) + padded[start + i], h)
        return mix(h + span.astype(np.uint64)), before


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts hold about ``limit`` bytes, so that a worker's memory is bounded by its longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(pc.binary_length(batch.column(column)).cast(pa.float64()).to_numpy(zero_copy_only=False))
        total = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0.0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


# --- sums of long vectors

#: Vectors that one task adds up, at most.
FAN_IN = 4


def tree_sum(parts: DataFrame, n: int | None = None, kind: str = "f8") -> np.ndarray:
    """Sum of the vectors (of numpy type ``kind``) in column ``v`` of rows (part, v), as doubles, in an order that the numbers ``part`` give; none: an empty one.

    ``part`` numbers rows from 0 on, each once, below ``n`` (by default the number of partitions).  Level by level a task
    adds FAN_IN vectors at most; the driver gets one.
    """

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("v").to_pylist()))
        total = np.zeros(len(rows[0][1]) // np.dtype(kind).itemsize)
        for _, v in rows:
            total += np.frombuffer(v, kind)
        return pa.table({"part": pa.array([rows[0][0] // FAN_IN], pa.int64()), "v": pa.array([total.astype(kind).tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions() if n is None else n
    while n > 1:
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(add, "part long, v binary")
        n = -(-n // FAN_IN)
    rows = sorted((r.part, r.v) for r in parts.collect())
    return sum(np.frombuffer(v, kind).astype(np.float64) for _, v in rows) if rows else np.zeros(0)
