"""Streams of spans: rollups with a watermark, duplicates, stateful sampling, and table sinks.

Event time must be a timestamp with zone: Spark takes no other for watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def file_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """One of the folder's tables as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # A table is one file or a folder of files.
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parque[t]")


def event_spans(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("model_"), F.col("user_id") % 5).alias("model_id"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def rollup(spans: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts, latency sums and errors by window and model; spans later than ``LATE`` are left out."""
    w = F.window("timestamp", width)
    return spans.withWatermark("timestamp", LATE).groupBy(w.alias("w"), "model_id").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency_sum"), F.count_if("is_error").alias("errors")
    )


def distinct_spans(spans: DataFrame) -> DataFrame:
    return spans.withWatermark("timestamp", LATE).dropDuplicatesWithinWatermark(["trace_id"])


def sliding(spans: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Counts and errors by overlapping window and model."""
    w = F.window("timestamp", width, step)
    return spans.withWatermark("timestamp", LATE).groupBy(w.alias("w"), "model_id").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


def alert_episodes(events: DataFrame, minutes: int = 15, ttl_hours: int = 24, silences: DataFrame | None = None) -> DataFrame:
    """Episodes of (fingerprint, timestamp) events: opened, resolved after ``minutes`` without one, and forgotten.

    A session window joins what belongs together however late and shuffled it came, within the watermark; it
    is given out when it can no longer grow, which is when the alert resolves itself.  ``notify_at`` is
    when it is sent: at once, or at the end of the last of the ``silences`` (start, stop, fingerprint or null for
    all) that cover the time of sending; null where the alert has resolved by then.  The silences are a small table.
    """
    w = F.session_window("timestamp", f"{minutes * 60_000_000 - 1} microseconds")  # Spark joins what is just so far apart
    out = events.withWatermark("timestamp", LATE).groupBy(w.alias("w"), "fingerprint").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_at"))
    out = out.select("fingerprint", F.col("w.start").alias("opened_at"), "last_at", (F.col("last_at") + F.make_dt_interval(mins=F.lit(minutes))).alias("resolved_at"), "n")
    out = out.withColumn("expires_at", F.col("last_at") + F.make_dt_interval(hours=F.lit(ttl_hours)))
    if silences is None:
        return out.withColumn("notify_at", F.col("opened_at"))
    rows = silences.groupBy().agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("fingerprint").alias("only")))).alias("silences"))
    covers = lambda at, s: (s["start"] <= at) & (at < s["stop"]) & (s["only"].isNull() | (s["only"] == F.col("fingerprint")))
    # By start: a silence that begins within another one carries on from it.
    at = F.aggregate("silences", F.col("opened_at"), lambda at, s: F.when(covers(at, s), s["stop"]).otherwise(at))
    out = out.crossJoin(F.broadcast(rows)).withColumn("at", at)  # one row
    return out.withColumn("notify_at", F.when(F.col("at") < F.col("resolved_at"), F.col("at"))).drop("silences", "at")


def rate_limited(spans: DataFrame, rate: float, burst: float) -> DataFrame:
    """A token bucket for each service, kept in the state store and filled by event time.

    Within a micro-batch a service's spans are taken in order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (burst, None)
        frame = pd.concat(list(frames)).sort_values(["timestamp", "trace_id"])
        kept = []
        for now in frame["timestamp"].to_numpy("datetime64[us]").astype("int64") / 1e6:
            left = burst if last is None else min(burst, left + max(now - last, 0.0) * rate)
            kept.append(left >= 1)
            left -= kept[-1]
            last = now if last is None else max(last, now)
        state.update((left, last))
        yield frame.loc[kept, ["trace_id", "service_name"]]

    return spans.groupBy("service_name").applyInPandasWithState(
        step, "trace_id string, service_name string", "left double, last double", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what is there now, batch by batch; a restart goes on at the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Work off what is there and give the stream's result as a table: the last batch in complete mode, else all.

    ``folder`` is one that all executors see.  It holds the checkpoint and the batches, so a later call with
    the same folder goes on where this one ended.  A batch has its own folder by number: one that is run
    again after a failure replaces itself.
    """
    spark = stream.sparkSession
    run_once(stream, mode, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}"), f"{folder}/checkpoint")
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    done = sorted(int(status.getPath().getName().removeprefix("batch-")) for status in found)
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = done[-1:] if mode == "complete" else done
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/batch-{n}" for n in wanted))
