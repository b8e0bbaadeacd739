"""Keyed state inside a stream: the last value of every key, with deletes, resumed from its checkpoint [W1, W3, W4]."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What transformWithState needs to keep its state in.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state of a key: order of its last update, that update's value, and whether it was a delete.
STATE = "at timestamp, tie bigint, value double, deleted boolean"


class LastValue(StatefulProcessor):
    """The newest update of a key by (at, tie) over all batches, in whatever order they come.

    A null value deletes its key. The delete itself is remembered, so an older update that comes late does not bring the
    key back; with `forget` such remains go after that many milliseconds.
    """

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            row = part.sort_values(["at", "tie"]).iloc[-1]
            if best is None or (row["at"], row["tie"]) > (best["at"], best["tie"]):
                best = row
        if best is None:
            return
        known = self.last.get() if self.last.exists() else None
        if known is not None and (pd.Timestamp(known[0]), known[1]) >= (pd.Timestamp(best["at"]), int(best["tie"])):
            return
        gone = bool(pd.isna(best["value"]))
        self.last.update((best["at"].to_pydatetime(), int(best["tie"]), None if gone else float(best["value"]), gone))
        yield pd.DataFrame({"key": [key[0]], "value": [None if gone else float(best["value"])], "deleted": [gone]})

    def close(self) -> None:
        pass


def track(updates: DataFrame, target: str, checkpoint: str, forget: int | None = None) -> None:
    """Take in all updates (key string, at timestamp, tie long, value double) that have come since the last call, then stop.

    The state lives in the checkpoint, one partition of keys a task; a call after a crash goes on with the batch that was
    not finished. target gets (key, value, deleted) of every key that changed, as Parquet.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = updates.select("key", "at", "tie", "value").groupBy("key").transformWithStateInPandas(LastValue(forget), "key string, value double, deleted boolean", "Update", "None")
    # A batch that was not finished is run again and writes over what it had left.
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n:09d}")
    q = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def tracked(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value) of the keys that are there, read from the state itself."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return state.where("NOT value.deleted").select(F.col("key.key").alias("key"), F.col("value.value").alias("value"))
