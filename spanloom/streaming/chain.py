"""Processors one after the other, where a failure costs a row one processor and not the job.

A processor is either a set of column expressions with one that says what is wrong with a row, or a function of pandas
frames.  Where it fails, a row keeps its earlier form and goes on, or stops; either way it carries who failed and why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FAILURES = "array<struct<processor:string,error:string>>"


@dataclass
class Processor:
    """``change`` has new columns by name, and ``error`` a text where a row must not be changed, else null;
    or ``run`` takes a frame and gives one of the same rows and columns, in order.

    ``rate`` is the share of rows that are processed, the same ones in every run: by a hash of ``key``.
    """

    name: str
    change: dict[str, Column] = field(default_factory=dict)
    error: Column | None = None
    run: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    rate: float = 1.0


def _guarded(processor: Processor, columns: list[str]):
    """Runs the function on as large a part of a batch as it takes; a row that it does not take stays as it was."""

    def one(frame: pd.DataFrame) -> tuple[list[pd.DataFrame], np.ndarray]:
        """The parts in order, and what is wrong with each row.  A part that fails is halved."""
        done, errors, todo = [], np.full(len(frame), None, object), [(0, len(frame))]
        while todo:
            i, j = todo.pop()
            part = frame.iloc[i:j]
            try:
                out = processor.run(part.copy())
                if len(out) != j - i:
                    raise ValueError("rows were lost or added")
                done.append(out[columns])
            except Exception as error:  # of whatever kind: it is reported with the row
                if j - i == 1:
                    done.append(part)
                    errors[i] = f"{type(error).__name__}: {error}"[:500]
                else:
                    half = (i + j) // 2
                    todo += [(half, j), (i, half)]
        return done, errors

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["_due"].to_numpy(bool)
            errors = np.full(len(frame), None, object)
            if not own.any():
                yield frame[columns].assign(failures=frame["failures"], _error=errors)
                continue
            parts, errors[own] = one(frame.loc[own, columns].reset_index(drop=True))
            done = pd.concat(parts, ignore_index=True)
            if not own.all():  # back between the rows that are not due
                places = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
                done = pd.concat([done, frame.loc[~own, columns]], ignore_index=True).iloc[np.argsort(places)].reset_index(drop=True)
            yield done.assign(failures=frame["failures"].to_numpy(), _error=errors)

    return run


def run_chain(rows: DataFrame, processors: list[Processor], key: str, stop: bool = False, observed: Observation | str | None = None) -> DataFrame:
    """``rows`` after all processors, with ``failures``: an array of processor and error.

    With ``stop`` a row that failed is left alone by the processors that follow.  ``observed`` counts, as the rows
    pass: ``rows``, and for each processor ``failed_<name>``; in a stream an observation's name, by which a listener
    finds the counts in each batch's progress.  The table must have no columns named failures, _due or _error.
    """
    columns = rows.columns
    out = rows.withColumn("failures", F.lit(None).cast(FAILURES)).withColumn("failures", F.coalesce("failures", F.array().cast(FAILURES)))
    if any(p.run for p in processors):  # a batch may cost many calls, so all tasks share the rows however few files hold them
        out = out.repartition(key)
    for p in processors:
        due = F.lit(True)
        if p.rate < 1:
            due = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(p.name)), F.lit(1 << 30)) < int(p.rate * (1 << 30))
        if stop:
            due = due & (F.size("failures") == 0)
        if p.run:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            out = out.withColumn("_due", due).mapInPandas(_guarded(p, columns), f"{schema}, failures {FAILURES}, _error string")
        else:
            error = F.when(due, p.error if p.error is not None else F.lit(None).cast("string"))
            out = out.withColumns({"_due": due, "_error": error})
            fine = F.col("_due") & F.col("_error").isNull()
            out = out.withColumns({c: F.when(fine, new).otherwise(F.col(c)) if c in columns else new for c, new in p.change.items()}).drop("_due")
        failed = F.array(F.struct(F.lit(p.name).alias("processor"), F.col("_error").alias("error")))
        out = out.withColumn("failures", F.when(F.col("_error").isNotNull(), F.concat("failures", failed)).otherwise(F.col("failures"))).drop("_error")
    if observed is not None:
        count = lambda name: F.count_if(F.exists("failures", lambda f: f["processor"] == name)).alias(f"failed_{name}")
        out = out.observe(observed, F.count(F.lit(1)).alias("rows"), *(count(p.name) for p in processors))
    return out
