"""Reading and writing: Spark's own connectors under one name each, array-likes, and batches of results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def from_arrays(spark: SparkSession, **columns) -> DataFrame:
    """A frame of equally long array-likes."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({k: list(v) for k, v in columns.items()}))


def to_numpy(df: DataFrame):
    return df.toPandas().to_numpy()


def collect_batches(df: DataFrame, size: int = 10_000) -> Iterator[list[Row]]:
    """Rows in lists of ``size``, one partition on the driver at a time."""
    batch: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


class Compat:
    """Any function of a module on array-likes: compat(spark, module).name(arrays, ...) gives the result's rows."""

    def __init__(self, spark: SparkSession, module) -> None:
        self._spark, self._module = spark, module

    def __getattr__(self, name: str):
        f = getattr(self._module, name)

        def run(*args, **kwargs):
            arrays = {f"c{i}": a for i, a in enumerate(args) if hasattr(a, "__len__") and not isinstance(a, str)}
            df = from_arrays(self._spark, **arrays)
            named = [f"c{i}" if f"c{i}" in arrays else a for i, a in enumerate(args)]
            out = df.select(f(*named, **kwargs).alias("value"))
            return [r.value for r in out.collect()]

        return run
