"""Incremental runs over file streams: last-wins merge and windowed counts with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.operators.shared import shared_folder

from .ledger import Inbox, loaded, merge_batch


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def newest(spark: SparkSession, target: str, schema) -> DataFrame:
    """The newest generation that was written whole, also after a restart that found nothing new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/gen=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = [int(f.getPath().getParent().getName().partition("=")[2]) for f in found]
    return spark.read.schema(schema).parquet(f"{target}/gen={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def file_stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, a few files a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_merge(stream: DataFrame, target: str, keys: list[str], version: str) -> DataFrame:
    """Fold a stream into a keyed table. Keys are spread over buckets, and a micro-batch writes the buckets that it touches
    to a folder of its own: nothing is read from the path that is written, a replayed batch writes the same rows, and the
    cost of a batch follows its keys' buckets and not the table."""
    spark = stream.sparkSession
    inbox = Inbox("", target, stream.schema, tuple(keys), version)
    query = stream.writeStream.foreachBatch(lambda batch, number: merge_batch(spark, inbox, batch, number)).option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start()
    query.awaitTermination()
    return loaded(spark, inbox)


def merged_stream(spark: SparkSession, folder: str) -> DataFrame:
    """TS02, TS03: the latest event of each user and kind, merged batch by batch."""
    return run_merge(file_stream(spark, folder, "events").select("event_id", "user_id", "event_type", "ts"), _folder(spark), ["user_id", "event_type"], "ts")


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """TS01: daily counts of a whole stream: complete mode keeps all windows, so no event is late."""
    events = file_stream(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counts = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    target = _folder(spark)
    flat = counts.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/gen={number}")

    query = flat.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(spark, target, flat.schema)


def closed_windows(stream: DataFrame, on: str, keys: list[str], size: str, late: str, target: str) -> DataFrame:
    """TS01: counts of windows that are over, each written once, when the watermark has passed its end.
    State holds open windows only; a row that is later than ``late`` is not counted."""
    counts = stream.withWatermark(on, late).groupBy(F.window(on, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(F.col("w.start").alias("start"), *keys, "n")
    query = flat.writeStream.outputMode("append").format("parquet").option("path", f"{target}/closed").option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(flat.schema).parquet(f"{target}/closed")
