"""What a stream has done so far, and latencies by a sketch that can be merged."""

from __future__ import annotations

import math
import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: Weight of the newest batch in moving averages.
ALPHA = 0.1
#: Relative error of a quantile of a latency sketch.
ERROR = 0.01
_GAMMA = (1 + ERROR) / (1 - ERROR)


class Statistics(StreamingQueryListener):
    """Counts and moving averages of the streams of a session, by the query's name or id.

    Register it with ``spark.streams.addListener``.  Failures are those that a chain of processors observes
    (:func:`spanloom.streaming.chain.run_chain` with an observation's name).
    """

    def __init__(self, alpha: float = ALPHA):
        self.alpha, self.lock, self.queries = alpha, threading.Lock(), {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self.lock:
            self._of(event.name or str(event.id))["running"] = True

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        failed = sum(v for row in p.observedMetrics.values() for k, v in row.asDict().items() if k.startswith("failed_"))
        self.add(p.name or str(p.id), p.numInputRows, p.durationMs.get("triggerExecution", 0), failed)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self.lock:
            for state in self.queries.values():
                if state["id"] in (None, str(event.id)):
                    state["running"] = False

    def _of(self, name: str) -> dict:
        start = {"id": None, "running": False, "batches": 0, "rows": 0, "failed": 0, "avg_batch_size": 0.0, "avg_ms": 0.0, "slow_ms": 0.0}
        return self.queries.setdefault(name, start)

    def add(self, name: str, rows: int, millis: float, failed: int = 0) -> None:
        """One batch; batches without rows are not counted."""
        if not rows:
            return
        with self.lock:
            s, a = self._of(name), self.alpha
            s["batches"] += 1
            s["rows"] += rows
            s["failed"] += failed
            s["avg_batch_size"] += a * (rows - s["avg_batch_size"])
            s["avg_ms"] += a * (millis - s["avg_ms"])
            # Follows a slower batch nearly at once, and quicker ones hardly.
            s["slow_ms"] += (0.99 if millis > s["slow_ms"] else 0.01) * (millis - s["slow_ms"])

    def of(self, name: str) -> dict:
        with self.lock:
            return dict(self._of(name))


def bucket(x: Column) -> Column:
    """The bucket of a positive number: their bounds grow by a constant factor; 0 and less have none."""
    return F.when(x > 0, F.ceil(F.log(x) / math.log(_GAMMA))).cast("int")


def sketch(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, bucket, n): how many values lie in each bucket, null for 0 and less; null values are left out."""
    return rows.where(F.col(x).isNotNull()).groupBy(*keys, bucket(F.col(x)).alias("bucket")).agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all: that of their rows together."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def quantiles(sketched: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, and p of each share): the value at that share of the sorted values, within ``ERROR`` of it.

    A key has as many rows as buckets, some 2,300 for all numbers between a nanosecond and a thousand years.
    """
    buckets = F.array_sort(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-(1 << 30))).alias("b"), "n")))
    out = sketched.groupBy(*keys).agg(buckets.alias("bs"), F.sum("n").alias("n"))

    def at(share: float) -> Column:
        place = F.floor(share * (F.col("n") - 1))
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("b"))
        step = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.when(s["b"].isNull() & (s["upto"] + x["n"] > place), x["b"]).otherwise(s["b"]).alias("b"))
        found = F.aggregate("bs", start, step, lambda s: s["b"])
        return F.when(found == -(1 << 30), 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), found) / (_GAMMA + 1))

    return out.select(*keys, "n", *(at(s).alias(f"p{s * 100:g}".replace(".", "_")) for s in shares))
