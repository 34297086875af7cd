"""Row-dropping operators: the same trace always gets the same decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = float(16**15)


def share(trace_id: Column) -> Column:
    """A number in [0, 1) that only depends on the trace."""
    return F.conv(F.substr(F.md5(trace_id.cast("string")), F.lit(1), F.lit(15)), 16, 10).cast("double") / _RANGE


def probabilistic(rows: DataFrame, rate: float, trace: str = "trace_id") -> DataFrame:
    return rows.where(share(F.col(trace)) < min(max(rate, 0.0), 1.0))


def parent_based(rows: DataFrame, rate: float) -> DataFrame:
    """Roots by ``rate``; a child follows ``sampled=...`` of its trace state, else the root's rule."""
    state = F.regexp_extract("trace_state", "sampled=(true|1|false|0)", 1)
    kept = F.when(F.coalesce("parent_span_id", F.lit("")) == "", share(F.col("trace_id")) < rate)
    kept = kept.when(state.isin("true", "1"), True).when(state.isin("false", "0"), False).otherwise(share(F.col("trace_id")) < rate)
    return rows.where(kept)


def by_service(rows: DataFrame, rates: dict[str, float], default: float) -> DataFrame:
    rate = F.lit(default)
    for service, own in rates.items():
        rate = F.when(F.col("service_name") == service, F.lit(own)).otherwise(rate)
    return rows.where(share(F.col("trace_id")) < rate)


def enrich(rows: DataFrame, **attributes: str) -> DataFrame:
    """Adds fixed attributes to the map; a row's own value of a name stays."""
    fixed = F.create_map(*(F.lit(x) for kv in sorted(attributes.items()) for x in kv))
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(fixed, lambda k, v: ~F.map_contains_key(own, k))
    return rows.withColumn("attributes", F.map_concat(kept, own))
