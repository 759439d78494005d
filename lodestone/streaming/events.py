"""Event streams with watermarks: one trigger for each slot, sessions, and idempotent merges of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import merge


def read_events(spark: SparkSession, path: str, schema: str, at: str = "ts") -> DataFrame:
    """Files of events as a stream; the moment becomes a timestamp with a zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def slot_triggers(events: DataFrame, kind: str, minutes: int, late: str = "1 day", at: str = "ts") -> DataFrame:
    """One row for each kind and tumbling slot, the first time that the slot has an event; the state of a slot goes with the watermark."""
    slots = events.withWatermark(at, late).select(kind, F.window(at, f"{minutes} minutes").alias("slot"), at)
    started = slots.select(kind, F.col("slot.start").alias("slot"), at)
    return started.dropDuplicatesWithinWatermark([kind, "slot"]).select(kind, "slot")


def session_counts(events: DataFrame, key: str, gap: str, late: str = "1 day", at: str = "ts") -> DataFrame:
    """Sessions of each key: runs of events without a gap, counted once the watermark has passed them."""
    found = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("_s.start").alias("started"), "n")


def slot_counts(events: DataFrame, kind: str, minutes: int, late: str = "1 day", at: str = "ts") -> DataFrame:
    """Events of each kind and tumbling slot; a slot is given once the watermark has passed it."""
    found = events.withWatermark(at, late).groupBy(kind, F.window(at, f"{minutes} minutes").alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(kind, F.col("_w.start").alias("slot"), "n")


def insert_batches(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], arrival: str) -> StreamingQuery:
    """Add each micro-batch's new keys to a table: late and repeated rows are accepted once, however late, and a batch that runs again adds nothing.

    A batch writes its own folder of the table, which replaces that of an earlier run of the same batch; rows that other batches
    hold are found by an anti join.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batch={number}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        there = files.exists(place) and any(f"batch={number}" != f.getPath().getName() and f.isDirectory() for f in files.listStatus(place))
        held = spark.read.option("basePath", path).schema(f"{batch.select(*keys)._jdf.schema().toDDL()}, batch long").parquet(path).where(F.col("batch") != number).select(*keys) if there else batch.limit(0).select(*keys)
        merge.new_rows(held, batch, keys, arrival).write.mode("overwrite").parquet(folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived, into a table, and return the table."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
