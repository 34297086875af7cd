"""Operators whose next step depends on what they decided before, one state a key.

Rows of a key are ordered by (timestamp, seq).  Where a window function can express the rule until its
first alarm, it does; rules that reset, block or drop carry a small state along the key's sorted rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(rows: DataFrame, start, step, schema: str) -> DataFrame:
    """``step(state, frame)`` gives the new rows of a run of one key's rows, in order, and moves its state on.

    Rows of a key stream through one task in Arrow batches; only the state is held, which ``start()`` makes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for frame in frames:
            keys = frame["key"].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if keys[i] != key:
                    key, state = keys[i], start()
                yield step(state, frame.iloc[i:j])

    return rows.repartition("key").sortWithinPartitions("key", "timestamp", "seq").mapInPandas(run, schema)


def _seconds(frame: pd.DataFrame) -> np.ndarray:
    return frame["timestamp"].to_numpy("datetime64[us]").astype(np.int64) / 1e6


def admit(rows: DataFrame, limit: int) -> DataFrame:
    """Sequential budget: an amount that would pass the limit is blocked and not added."""

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        allowed, after = [], []
        for amount in frame["amount"]:
            ok = state["spent"] + amount <= limit
            state["spent"] += amount if ok else 0
            allowed.append(ok)
            after.append(state["spent"])
        return pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "allowed": allowed, "spent": after})

    return in_order(rows, lambda: {"spent": 0}, step, "key string, seq long, allowed boolean, spent long")


def token_bucket(rows: DataFrame, rate: float, burst: float) -> DataFrame:
    """Sampling at ``rate`` a second with a burst; ``timestamp`` decides how far a bucket has filled."""

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for now in _seconds(frame):
            last = state["last"]
            left = burst if last is None else min(burst, state["left"] + (now - last) * rate)
            kept.append(left >= 1)
            state.update(left=left - kept[-1], last=now)
        return pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "kept": kept})

    return in_order(rows, lambda: {"left": burst, "last": None}, step, "key string, seq long, kept boolean")


def cooldown(rows: DataFrame, seconds: float) -> DataFrame:
    """Alerts that go out: the first, then each that comes ``seconds`` or more after the last that went out."""

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        sent = []
        for now in _seconds(frame):
            sent.append(now - state["last"] >= seconds)
            state["last"] = now if sent[-1] else state["last"]
        return pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "sent": sent})

    return in_order(rows, lambda: {"last": -math.inf}, step, "key string, seq long, sent boolean")


def rate_limits(rows: DataFrame, limits: dict[float, int]) -> DataFrame:
    """Which rows pass when at most so many go out in any so many seconds before, for all limits at once."""

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        sent, out = state["sent"], []
        for now in _seconds(frame):
            while sent and now - sent[0] >= max(limits):
                sent.popleft()
            held = np.fromiter(sent, float, len(sent))
            out.append(all((now - held < width).sum() < most for width, most in limits.items()))
            if out[-1]:
                sent.append(now)
        return pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "sent": out})

    return in_order(rows, lambda: {"sent": deque()}, step, "key string, seq long, sent boolean")


def _order() -> tuple:
    ordered = Window.partitionBy("key").orderBy("timestamp", "seq")
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, 0)


def ddm(rows: DataFrame, least: int = 30) -> DataFrame:
    """Drift detection on an error stream (key, timestamp, seq, error 0/1): state after every row."""
    ordered, upto = _order()
    n, p = F.count("error").over(upto), F.avg("error").over(upto)
    out = rows.withColumn("n", n).withColumn("p", p).withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    level = F.when(F.col("n") >= least, F.round(F.col("p") + F.col("s"), 12))
    best = F.min(F.when(level.isNotNull(), F.struct(level.alias("l"), F.col("n").alias("n"), F.col("p").alias("p"), F.col("s").alias("s")))).over(upto)
    out = out.withColumn("best", best)
    now = F.col("p") + F.col("s")
    state = F.when(now >= F.col("best.p") + 3 * F.col("best.s"), "drift").when(now >= F.col("best.p") + 2 * F.col("best.s"), "warning").otherwise("stable")
    state = F.when(F.col("n") < least, "stable").when(F.col("best.s") == 0, F.when(now > F.col("best.p"), "drift").otherwise("stable")).otherwise(state)
    return out.select("key", "seq", "n", F.round("p", 8).alias("p"), state.alias("state"))


def eddm(rows: DataFrame, window: int = 1000, least: int = 10) -> DataFrame:
    """Drift by the distance between errors: state at every error row."""
    ordered, _ = _order()
    numbered = rows.withColumn("i", F.row_number().over(ordered)).where("error = 1")
    gap = F.col("i") - F.lag("i").over(ordered)
    gaps = numbered.withColumn("gap", gap).where("gap is not null")
    frame = ordered.rowsBetween(-(window - 1), 0)
    level = F.avg("gap").over(frame) + 2 * F.stddev_pop("gap").over(frame)
    out = gaps.withColumn("n", F.row_number().over(ordered)).withColumn("level", level)
    best = F.max(F.when(F.col("n") >= least, F.col("level"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.round(F.try_divide(F.col("level"), best), 8)
    state = F.when(ratio < 0.5, "drift").when(ratio < 0.9, "warning").otherwise("stable")
    return out.select("key", "seq", F.col("n").cast("long").alias("n"), ratio.alias("ratio"), F.when(F.col("n") < least, "stable").otherwise(state).alias("state"))


def page_hinkley(rows: DataFrame, delta: float = 0.005, threshold: float = 50.0, least: int = 30) -> DataFrame:
    """The first alarm of each key on (key, timestamp, seq, x); the sum starts at 0, as does its minimum."""
    ordered, upto = _order()
    before = F.coalesce(F.avg("x").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    steps = rows.withColumn("n", F.row_number().over(ordered)).withColumn("step", F.col("x") - before - delta)
    sums = steps.withColumn("sum", F.sum("step").over(upto))
    stat = F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0.0))
    alarms = sums.withColumn("stat", stat).where((F.col("n") >= least) & (F.col("stat") > threshold))
    return alarms.groupBy("key").agg(F.min("n").cast("long").alias("n"), F.min_by("seq", "n").alias("seq"), F.round(F.min_by("stat", "n"), 4).alias("stat"))


def adwin(rows: DataFrame, delta: float = 0.002, least: int = 30, most: int = 100) -> DataFrame:
    """Adaptive windowing on (key, timestamp, seq, x): where and how far a key's window is cut.

    The window is a list of at most ``most`` buckets (sum, count); when full, the neighbours whose
    means are closest merge.  After each value the first cut whose sides differ by more than the
    Hoeffding bound drops the older side.
    """

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        sums, counts, cuts = state["sums"], state["counts"], []
        for seq, x in zip(frame["seq"], frame["x"], strict=True):
            sums, counts = np.append(sums, x), np.append(counts, 1.0)
            if len(sums) > most:
                k = int(np.argmin(np.abs(np.diff(sums / counts))))
                sums[k] += sums[k + 1]
                counts[k] += counts[k + 1]
                sums, counts = np.delete(sums, k + 1), np.delete(counts, k + 1)
            left, total = np.cumsum(counts)[:-1], counts.sum()
            right = total - left
            able = (left >= least / 2) & (right >= least / 2)
            if able.any():
                low = np.cumsum(sums)[:-1]
                gap = np.abs(low / left - (sums.sum() - low) / np.maximum(right, 1))
                cut = np.flatnonzero(able & (gap > np.sqrt(0.5 * (1 / left + 1 / np.maximum(right, 1)) * np.log(4 / delta))))
                if len(cut):
                    k = int(cut[0]) + 1
                    sums, counts = sums[k:], counts[k:]
                    cuts.append((seq, int(counts.sum()), float(sums.sum() / counts.sum())))
        state.update(sums=sums, counts=counts)
        return pd.DataFrame([(frame["key"].iloc[0], *c) for c in cuts], columns=["key", "seq", "width", "mean"])

    return in_order(rows, lambda: {"sums": np.zeros(0), "counts": np.zeros(0)}, step, "key string, seq long, width long, mean double")


def streak(rows: DataFrame, violated: Column) -> DataFrame:
    """Adds ``streak``: how many rows in a row, up to this one, violate (gaps and islands)."""
    ordered, upto = _order()
    bad = rows.withColumn("_bad", violated)
    island = bad.withColumn("_island", F.count_if(~F.col("_bad")).over(upto))
    run = F.count_if("_bad").over(Window.partitionBy("key", "_island").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("streak", F.when(F.col("_bad"), run).otherwise(0)).drop("_bad", "_island")
