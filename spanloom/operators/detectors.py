"""Drift detectors that can stop at any row and go on later: each is a small state, kept as JSON.

A detector takes the values of a key one by one and says what it finds.  :func:`advance` runs detectors of all
keys over a table, from states that an earlier run saved; :mod:`spanloom.streaming.stateful` keeps the same states in
Spark's state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import Workspace

FOUND = "key string, seq long, n long, state string, value double"


class Detector:
    """Keeps ``state``, which is plain JSON; ``update`` returns None or (n, state, value)."""

    def __init__(self, state: str | None = None, **settings):
        self.settings = settings
        self.state = json.loads(state) if state else self.start()

    def start(self) -> dict:
        raise NotImplementedError

    def update(self, x: float) -> tuple | None:
        raise NotImplementedError

    def dump(self) -> str:
        return json.dumps(self.state)


class Ddm(Detector):
    """Errors 0 or 1: the rate leaves its best level by two (warning) or three (drift) deviations."""

    def start(self):
        return {"n": 0, "errors": 0.0, "best": None}

    def update(self, x):
        s = self.state
        s["n"] += 1
        s["errors"] += x
        n, p = s["n"], s["errors"] / s["n"]
        if n < self.settings.get("least", 30):
            return None
        deviation = (p * (1 - p) / n) ** 0.5
        now = p + deviation
        level = [round(now, 12), n, p, deviation]
        s["best"] = min(s["best"] or level, level)
        _, _, low, spread = s["best"]
        if spread == 0:
            return (n, "drift", p) if now > low else None
        if now >= low + 3 * spread:
            return n, "drift", p
        return (n, "warning", p) if now >= low + 2 * spread else None


class Eddm(Detector):
    """Errors 0 or 1: the distance between errors, over the last ``window`` of them, falls below its best level."""

    def start(self):
        return {"i": 0, "last": None, "gaps": [], "n": 0, "best": None}

    def update(self, x):
        s = self.state
        s["i"] += 1
        if x != 1:
            return None
        last, s["last"] = s["last"], s["i"]
        if last is None:
            return None
        s["gaps"] = [*s["gaps"], s["i"] - last][-self.settings.get("window", 1000) :]
        s["n"] += 1
        if s["n"] < self.settings.get("least", 10):
            return None
        level = float(np.mean(s["gaps"]) + 2 * np.std(s["gaps"]))
        s["best"] = level if s["best"] is None else max(s["best"], level)
        ratio = round(level / s["best"], 8) if s["best"] else None
        return None if ratio is None or ratio >= 0.9 else (s["n"], "drift" if ratio < 0.5 else "warning", ratio)


class PageHinkley(Detector):
    """The sum of what exceeds the mean before by ``delta`` rises over its minimum; after an alarm it starts anew."""

    def start(self):
        return {"n": 0, "total": 0.0, "sum": 0.0, "low": 0.0}

    def update(self, x):
        s = self.state
        before = s["total"] / s["n"] if s["n"] else 0.0
        s["n"] += 1
        s["total"] += x
        s["sum"] += x - before - self.settings.get("delta", 0.005)
        s["low"] = min(s["low"], s["sum"])
        value, n = s["sum"] - s["low"], s["n"]
        if n < self.settings.get("least", 30) or value <= self.settings.get("threshold", 50.0):
            return None
        self.state = self.start()
        return n, "drift", value


class Adwin(Detector):
    """The window of :func:`spanloom.operators.sequential.adwin`; a cut reports its new width and mean."""

    def start(self):
        return {"sums": [], "counts": []}

    def update(self, x):
        least = self.settings.get("least", 30)
        sums, counts = np.array([*self.state["sums"], x]), np.array([*self.state["counts"], 1.0])
        if len(sums) > self.settings.get("most", 100):
            k = int(np.argmin(np.abs(np.diff(sums / counts))))
            sums[k], counts[k] = sums[k] + sums[k + 1], counts[k] + counts[k + 1]
            sums, counts = np.delete(sums, k + 1), np.delete(counts, k + 1)
        left = np.cumsum(counts)[:-1]
        right = counts.sum() - left
        found = None
        able = (left >= least / 2) & (right >= least / 2)
        if able.any():
            low = np.cumsum(sums)[:-1]
            gap = np.abs(low / left - (sums.sum() - low) / np.maximum(right, 1))
            cut = np.flatnonzero(able & (gap > np.sqrt(0.5 * (1 / left + 1 / np.maximum(right, 1)) * np.log(4 / self.settings.get("delta", 0.002)))))
            if len(cut):
                sums, counts = sums[cut[0] + 1 :], counts[cut[0] + 1 :]
                found = int(counts.sum()), "drift", float(sums.sum() / counts.sum())
        self.state = {"sums": sums.tolist(), "counts": counts.tolist()}
        return found


DETECTORS = {"ddm": Ddm, "eddm": Eddm, "page_hinkley": PageHinkley, "adwin": Adwin}


def run(detector: Detector, key, seqs, values) -> list[tuple]:
    return [(key, int(seq), *found) for seq, x in zip(seqs, values, strict=True) if (found := detector.update(float(x)))]


def advance(work: Workspace, rows: DataFrame, kind: str, states: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """What the detectors of all keys find in (key, timestamp, seq, x), and their states (key, state) afterwards.

    With the ``states`` of an earlier run a key goes on where that ended, so that a run in parts finds what one
    run finds.  Keys without new rows keep their state.  Rows of a key stream through one task in order; a null x is
    passed over.
    """
    make = DETECTORS[kind]
    some = rows.where("x is not null").select("key", "timestamp", "seq", F.col("x").cast("double").alias("x"), F.lit(None).cast("string").alias("saved"))
    if states is not None:
        blank = (F.lit(None).cast(some.schema[n].dataType).alias(n) for n in ("timestamp", "seq", "x"))
        some = states.select("key", *blank, F.col("state").alias("saved")).unionByName(some)

    def pass_over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, detector, columns = None, None, ["key", "seq", "n", "state", "value", "saved"]
        for frame in frames:
            out = []
            for k, seq, x, saved in zip(frame["key"], frame["seq"], frame["x"], frame["saved"]):
                if detector is None or k != key:
                    if detector is not None:
                        out.append((key, None, None, None, None, detector.dump()))
                    key, detector = k, make(saved, **settings)
                if saved is None and (found := detector.update(x)):
                    out.append((k, int(seq), *found, None))
            yield pd.DataFrame(out, columns=columns)
        if detector is not None:
            yield pd.DataFrame([(key, None, None, None, None, detector.dump())], columns=columns)

    dealt = some.repartition("key").sortWithinPartitions("key", F.col("saved").isNull(), "timestamp", "seq")
    both = work.save(dealt.mapInPandas(pass_over, f"{FOUND}, saved string"), kind)
    return both.where("saved is null").drop("saved"), both.where("saved is not null").select("key", F.col("saved").alias("state"))
