"""Trace search: ``service:api model:gpt-4 status:ok duration:>1000 time:last-24h has:drift some words``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = {"service": "service_name", "model": "model_id", "user": "user_id", "status": "status"}
_HAS = {"drift": "drift_score", "safety": "toxicity_score"}
_TEXTS = ("input_preview", "output_preview")


def search(traces: DataFrame, query: str) -> DataFrame:
    """The traces that meet all terms; times are relative to the newest trace.

    Terms on columns that the table lacks, and free words where it has no previews, match nothing.
    """
    wanted: list[Column] = []
    hours = None
    for term in query.split():
        field, colon, value = term.partition(":")
        if colon and field in _FIELDS:
            name = _FIELDS[field]
            match = F.lower(F.col(name)) == value.lower() if field == "status" else F.col(name) == value
        elif field == "duration" and (m := re.fullmatch(r"([<>])(\d+(?:\.\d+)?)", value)):
            match = F.col("latency_ms") > float(m[2]) if m[1] == ">" else F.col("latency_ms") < float(m[2])
        elif field == "time" and (m := re.fullmatch(r"last-(\d+)([hd])", value)):
            hours = int(m[1]) * (24 if m[2] == "d" else 1)
            continue
        elif field == "has" and value in _HAS:
            match = F.col(_HAS[value]) > 0 if _HAS[value] in traces.columns else F.lit(False)
        else:
            own = [F.contains(F.lower(F.col(t)), F.lit(term.lower())) for t in _TEXTS if t in traces.columns]
            match = reduce(Column.__or__, own, F.lit(False))
        wanted.append(match)
    out = traces.where(reduce(Column.__and__, wanted, F.lit(True)))
    if hours is None:
        return out
    newest = traces.agg(F.max("timestamp").alias("_newest"))
    return out.join(F.broadcast(newest)).where(F.expr(f"timestamp >= _newest - INTERVAL {hours} HOURS")).drop("_newest")
