"""Notifications and recents over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.recents import recents
from ..schemas import RECENTS_KEPT, TTL_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiry(StatefulProcessor):
    """Emits `shown` when a notification comes, and `expired` when a success has stood for its time."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kind = handle.getValueState("kind", "type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind = None
        for batch in rows:
            kind = batch["type"].iloc[-1]
        self.kind.update((kind,))
        for at in list(self.handle.listTimers()):  # what came under this id before no longer counts
            self.handle.deleteTimer(at)
        if kind == "success":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ms)
        yield pd.DataFrame({"id": [key[0]], "type": [kind], "state": ["shown"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind = self.kind.get()[0] if self.kind.exists() else None
        if kind == "success":
            self.kind.clear()
            yield pd.DataFrame({"id": [key[0]], "type": [kind], "state": ["expired"]})

    def close(self) -> None:
        pass


def expiring(stream: DataFrame, seconds: int = TTL_SECONDS) -> DataFrame:
    """stream: id, type. id, type, state. The session's state store provider must be STATE_STORE."""
    return stream.groupBy("id").transformWithStateInPandas(_Expiry(seconds), "id string, type string, state string", "Update", "ProcessingTime")


def keep_recents(stream: DataFrame, path: str, kept: int = RECENTS_KEPT):
    """A writer that folds each batch of openings into the list stored under path/<batch>; `latest` reads the newest."""

    def fold(batch: DataFrame, number: int) -> None:
        now = latest(batch.sparkSession, path, number)
        rows = batch if now is None else batch.unionByName(now.drop("pos"))
        recents(rows, kept).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(fold)


def latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The list after the last batch, or the last before that number; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{path}/{max(done)}") if done else None
