"""Streaming extensions: chunks of arriving documents, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import text_units
from tessera.sources.schemas import SOURCE_DOCUMENTS


def stream_units(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Chunk JSON documents as they arrive in a folder; a unit's id makes a repeated delivery harmless."""
    docs = spark.readStream.schema(SOURCE_DOCUMENTS).json(folder)

    def put(batch: DataFrame, number: int) -> None:
        units = text_units(batch).dropDuplicates(["id"])
        units.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value by type and window, with a watermark for late rows."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
