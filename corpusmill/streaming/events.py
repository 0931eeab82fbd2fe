"""The incremental side as Structured Streaming: first sightings, windows and sessions over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(stream: DataFrame, key: list[str], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Each key's first row; later ones are repeats. Without a time every key is remembered for ever; with one, a key is forgotten
    once the watermark has passed its row by `late`, so state stays bounded, and a repeat after that counts as first."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, time: str, width: str, late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessionized(stream: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that a stream holds now, by one availableNow run into a table under the folder: replaced by each batch in complete mode, else added to."""
    table, spark = f"{folder}/table", stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={number}")  # a batch that is run again replaces itself

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(table)
