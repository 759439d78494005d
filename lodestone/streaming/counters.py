"""Counters as state of a stream: misses of a key up to a ceiling, never counted again once the key was fetched, forgotten after a while."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: State stores that transformWithState needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = StructType([StructField("status", StringType()), StructField("strikes", LongType()), StructField("until", LongType())])


class StrikeProcessor(StatefulProcessor):
    """State of a key: fetched for good once it was fetched, no_file after ceiling misses, else missing.

    forget_ms: a key without a fetch is forgotten when no outcome has come for so long, by a timer of event time (None: never).
    """

    def __init__(self, ceiling: int, forget_ms: int | None):
        self.ceiling, self.forget_ms = ceiling, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("strikes", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, strikes, until = self.state.get() if self.state.exists() else ("missing", 0, None)
        latest = until
        for row in rows:
            if row["outcome"] == "fetched":
                status = "fetched"
            elif row["outcome"] == "missing":
                strikes = min(strikes + 1, self.ceiling)
            if self.forget_ms is not None and row["at_ms"] is not None:
                latest = max(latest or 0, row["at_ms"] + self.forget_ms)
        if status != "fetched":
            status = "no_file" if strikes >= self.ceiling else "missing"
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.state.update((status, strikes, latest))
        yield Row(key=key[0], status=status, strikes=strikes)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, strikes, _ = self.state.get()
        if status == "fetched":
            self.state.update((status, strikes, None))
            return
        self.state.clear()
        yield Row(key=key[0], status="forgotten", strikes=0)

    def close(self) -> None:
        pass


def strike_stream(outcomes: DataFrame, key: str, outcome: str, at: str, ceiling: int = 3, forget_ms: int | None = None, late: str = "1 day") -> DataFrame:
    """The state of each key whenever it changes: key, status, strikes. Equal outcomes in another order give the same last states."""
    rows = outcomes.withWatermark(at, late).select(F.col(key).cast("long").alias("key"), F.col(outcome).alias("outcome"), F.unix_millis(at).alias("at_ms"), at)
    schema = "key long, status string, strikes long"
    return rows.groupBy("key").transformWithState(StrikeProcessor(ceiling, forget_ms), outputStructType=schema, outputMode="Update", timeMode="None" if forget_ms is None else "EventTime")


def last_states(spark: SparkSession, states: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over all that has arrived and return each key's last state; a batch that runs again replaces its own folder."""
    old = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        write = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        write.foreachBatch(lambda batch, number: batch.withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={number}")).start().awaitTermination()
    finally:
        spark.conf.set(*(PROVIDER[0], old)) if old else spark.conf.unset(PROVIDER[0])
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("key").agg(F.max_by(F.struct("status", "strikes"), F.struct("batch", "at")).alias("_s")).select("key", "_s.*")
