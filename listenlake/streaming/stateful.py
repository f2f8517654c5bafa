"""Plays of a stream judged by keyed state: new, repeated or too late to tell, with no look at the table they go to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schema import PLAY_KEYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
DAY = 86_400_000_000
#: A column of our own beside the plays'; one that began with an underscore would be renamed on the way to the processor.
MICROS = "listenlake_micros"


class PlayGate(StatefulProcessor):
    """A key's state is the newest time it had and the times since then less ``horizon``, as one run of sorted longs (microseconds).

    State that no row has reached for ``idle_ms`` expires; a timer of each key does the same for times that have passed out of the horizon of
    all keys together, which a key without new plays would keep: ``horizon`` before the newest time that its task has seen.
    """

    def __init__(self, columns: list[str], time: str, horizon: int, idle_ms: int):
        self.columns, self.time, self.horizon, self.idle_ms = columns, time, horizon, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", T.StructType([T.StructField("newest", T.LongType()), T.StructField("times", T.BinaryType())]), self.idle_ms)
        self.newest = -(1 << 63)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.times.exists():
            newest, raw = self.times.get()
            seen = np.frombuffer(raw, dtype=np.int64)
        else:
            newest, seen = -(1 << 63), np.zeros(0, dtype=np.int64)
        known = newest  # rows of one batch may come in any order: they are judged by what was known before it
        for frame in rows:
            at = frame[MICROS].to_numpy(dtype=np.int64)
            late = at < known - self.horizon if known > -(1 << 63) else np.zeros(len(at), dtype=bool)
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            new = first & ~late & ~np.isin(at, seen)
            seen = np.union1d(seen, at[new])
            if len(at):
                newest = max(newest, int(at.max()))
            out = frame[self.columns].copy()
            out["verdict"] = np.where(late, "late", np.where(new, "new", "repeat"))
            yield out
        self.newest = max(self.newest, newest)
        self.times.update((newest, seen[seen >= newest - self.horizon].tobytes()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms // 2)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists():
            newest, raw = self.times.get()
            seen = np.frombuffer(raw, dtype=np.int64)
            kept = seen[seen >= self.newest - self.horizon]
            if len(kept) < len(seen):
                self.times.update((newest, kept.tobytes()))
        return iter(())

    def close(self) -> None:
        pass


def judged_plays(stream: DataFrame, *, time: str = "play_time", horizon_days: float = 7, idle_days: float = 90) -> DataFrame:
    """Every row of a stream of plays with ``verdict``: ``new`` for the first of a key (name, track and time), ``repeat`` for the others, ``late`` for
    one more than ``horizon_days`` before the newest that its name and track had in earlier batches: its repeats are forgotten.

    Which of several equal rows of a batch is the new one is left open. Rows without a time are late.
    """
    columns = stream.columns
    us = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))
    gate = PlayGate(columns, time, int(horizon_days * DAY), int(idle_days * DAY) // 1000)
    fields = T.StructType([*stream.schema.fields, T.StructField("verdict", T.StringType())])
    keyed = stream.withColumn(MICROS, us).groupBy(*[k for k in PLAY_KEYS[0] if k != time])
    return keyed.transformWithStateInPandas(gate, fields, "Append", "ProcessingTime")


def write_judged(judged: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write judged plays into ``target``, a folder a batch and a verdict; a batch that is sent again replaces its own folder. Nothing is read there.

    Runs until the source is drained, without the batches without rows that timers ask for, as they have no end: timers are seen to when
    rows come. State is kept in RocksDB, of which only changes go to the checkpoint.
    """
    spark = judged.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("verdict").option("compression", "zstd").parquet(f"{target.rstrip('/')}/batch={number}")

    before = {k: spark.conf.get(k) for k in (_PROVIDER, _EMPTY_BATCHES)}
    spark.conf.set(_PROVIDER, ROCKSDB)  # a query takes its settings when it starts
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def verdicts(spark: SparkSession, target: str, verdict: str) -> DataFrame:
    """The plays of one verdict that ``write_judged`` has put there."""
    return spark.read.parquet(target).where(F.col("verdict") == verdict).drop("verdict", "batch")
