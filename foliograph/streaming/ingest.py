"""Streaming admission of documents (an extension: files arrive and are published batch by batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def admit(stream: DataFrame, key: str = "file_hash", time: str = "created_at", late: str = "7 days") -> DataFrame:
    """Each hash once within the watermark; older state is dropped, so its size follows the window, not the history."""
    timed = stream.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark([key])


def publish(stream: DataFrame, target: str, checkpoint: str, stored: str | None = None, key: str = "file_hash") -> StreamingQuery:
    """Appends each batch, less what is stored already, and leaves a resumable checkpoint."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch if stored is None else batch.join(spark.read.parquet(stored).select(key).distinct(), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
