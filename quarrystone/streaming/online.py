"""The library on streams: row-wise functions need nothing; aggregates take a watermark; models take batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.linear import OnlineLR


def windowed(stream: DataFrame, ts: str, agg: list[Column], every: str, watermark: str, period: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Aggregates over tumbling or sliding windows; rows later than the watermark are dropped, state is bounded by it."""
    w = F.window(ts, period or every, every)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(w, *(by or [])).agg(*agg)


def session_windowed(stream: DataFrame, ts: str, agg: list[Column], gap: str, watermark: str, by: list[str] | None = None) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), *(by or [])).agg(*agg)


def online_regression(stream: DataFrame, model: OnlineLR, features: list[str], target: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Keeps the model up to date: each micro-batch is one aggregation of moments, merged once a batch id.

    After each batch the model's state goes to a folder beside the stream's own checkpoint, under the batch's id.  A restart from
    that checkpoint begins with the last state saved, and a batch that comes again after a failure is not merged twice.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint.rstrip('/')}-model"
    last = _restore(spark, folder, model)

    def update(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        if batch_id <= last:
            return
        model.update_df(batch, features, target)
        if state := model.state():
            rows = batch.sparkSession.createDataFrame([(batch_id, *state)], "batch long, a array<double>, b array<double>")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{batch_id:020d}")
        last = batch_id

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


def _restore(spark, folder: str, model: OnlineLR) -> int:
    """Gives the model the last state that was written whole; its batch, or -1."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    whole = sorted(x.getPath().getName() for x in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    if not whole:
        return -1
    row = spark.read.parquet(f"{folder}/{whole[-1]}").first()
    model.restore(row.a, row.b)
    for old in whole[:-2]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
    return row.batch
