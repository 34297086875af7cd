"""Streams whose operators keep state of their own: drift detectors, and batches that close by size or time.

They need the RocksDB state store, which :func:`use_rocksdb` chooses for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators import detectors
from spanloom.streaming.jobs import LATE

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Detecting(StatefulProcessor):
    def __init__(self, kind: str, settings: dict):
        self.kind, self.settings = kind, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("detector", "state string")

    def _detector(self) -> detectors.Detector:
        return detectors.DETECTORS[self.kind](self.saved.get()[0] if self.saved.exists() else None, **self.settings)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        detector = self._detector()
        frame = pd.concat(list(rows)).dropna(subset=["x"]).sort_values(["timestamp", "seq"])  # of one micro-batch
        found = detectors.run(detector, key[0], frame["seq"], frame["x"])
        self.saved.update((detector.dump(),))
        yield pd.DataFrame(found, columns=["key", "seq", "n", "state", "value"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.saved.update((initialState["state"].iloc[0],))

    def close(self) -> None:
        pass


def detect(rows: DataFrame, kind: str, states: DataFrame | None = None, **settings) -> DataFrame:
    """What the detectors find in a stream of (key, timestamp, seq, x).

    States live in the state store and survive restarts; ``states`` (key, state), a table of an earlier batch
    run, is where a new stream begins.  Rows of a key within a micro-batch are taken in order of time.
    """
    use_rocksdb(rows.sparkSession)
    initial = states.groupBy("key") if states is not None else None
    processor = _Detecting(kind, settings)
    return rows.groupBy("key").transformWithStateInPandas(processor, detectors.FOUND, "append", "none", initialState=initial)


class _Batching(StatefulProcessor):
    def __init__(self, least: int, most: int, seconds: float):
        self.least, self.most, self.millis = least, most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "trace_id string, at long")
        self.batch = handle.getValueState("batch", "number long, n long, timer long")

    def _close(self, key, number: int, rows: list[tuple], why: str) -> pd.DataFrame:
        return pd.DataFrame({"model_id": key[0], "batch": number, "trace_id": [r[0] for r in rows], "closed_by": why})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, n, timer = self.batch.get() if self.batch.exists() else (0, 0, None)
        held = list(self.rows.get()) if n else []
        frame = pd.concat(list(rows)).sort_values(["timestamp", "trace_id"])
        at = frame["timestamp"].to_numpy("datetime64[ms]").astype("int64")
        came = list(zip(frame["trace_id"], at.tolist(), strict=True))
        held += came
        while len(held) >= self.most:
            yield self._close(key, number, held[: self.most], "size")
            number, held = number + 1, held[self.most :]
        if len(held) >= self.least:
            yield self._close(key, number, held, "enough")
            number, held = number + 1, []
        if timer is not None and (not held or number != self.batch.get()[0]):
            self.handle.deleteTimer(timer)
            timer = None
        if held and timer is None:
            timer = max(held[0][1], timerValues.getCurrentWatermarkInMs()) + self.millis
            self.handle.registerTimer(timer)
        self._keep(number, held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, n, timer = self.batch.get()
        if n and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self._close(key, number, list(self.rows.get()), "time")
            self._keep(number + 1, [], None)

    def _keep(self, number: int, held: list[tuple], timer: int | None) -> None:
        self.rows.clear()
        if held:
            self.rows.put([tuple(r) for r in held])
        self.batch.update((number, len(held), timer))

    def close(self) -> None:
        pass


def batches(spans: DataFrame, least: int = 100, most: int = 10_000, seconds: float = 60.0) -> DataFrame:
    """(model_id, batch, trace_id, closed_by) of a stream of spans: which batch of its model a span is in.

    After a micro-batch a model's batch closes when it has ``least`` spans, never with more than ``most``; one with
    fewer closes when event time has passed its first span by ``seconds``.
    """
    use_rocksdb(spans.sparkSession)
    marked = spans.select("model_id", "trace_id", "timestamp").withWatermark("timestamp", LATE)
    schema = "model_id string, batch long, trace_id string, closed_by string"
    return marked.groupBy("model_id").transformWithStateInPandas(_Batching(least, most, seconds), schema, "append", "eventTime")
