"""Rollups, breakdowns and lists over traces and evaluations.

Aggregates keep sums next to counts, so coarser rollups can be made of finer ones; percentiles are
taken anew from the base rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates of the generic metric query.
AGGREGATES = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "p50": lambda c: F.percentile(c, 0.5),
    "p95": lambda c: F.percentile(c, 0.95),
    "p99": lambda c: F.percentile(c, 0.99),
}


def slice_metrics_of() -> dict[str, Column]:
    """Metrics of slices, as aggregates over traces; made when used, as columns need a session."""
    return {
        "error_rate": F.avg(F.col("is_error").cast("double")),
        "avg_latency": F.avg("latency_ms"),
        "p95_latency": F.percentile("latency_ms", 0.95),
        "total_cost": F.sum("cost_micros"),
        "token_usage": F.sum(F.col("input_tokens") + F.col("output_tokens")),
        "n": F.count("*"),
    }


def hour(column: str = "timestamp") -> Column:
    return F.date_trunc("hour", column).cast("timestamp_ntz")


def day(column: str = "timestamp") -> Column:
    return F.date_trunc("day", column).cast("timestamp_ntz")


def traces_hourly(traces: DataFrame) -> DataFrame:
    """Count, tokens, cost, latency and errors by hour, service, model and provider."""
    return traces.groupBy(hour().alias("hour"), "service_name", "model_id", "provider").agg(
        F.count("*").alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_micros").alias("cost_micros"),
        F.round(F.sum("latency_ms"), 4).alias("latency_sum"),
        F.count_if("is_error").alias("errors"),
    )


def daily_costs(traces: DataFrame) -> DataFrame:
    return traces.groupBy(day().alias("day"), "model_id", "provider", "service_name", "user_id").agg(
        F.count("*").alias("requests"),
        F.sum("cost_micros").alias("cost_micros"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )


def period_rollup(traces: DataFrame, period: str) -> DataFrame:
    """Requests, latency percentiles and error rate by period, service and model."""
    start = F.date_trunc(period, "timestamp").cast("timestamp_ntz").alias("period_start")
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = traces.groupBy(start, "service_name", "model_id").agg(
        F.count("*").alias("requests"), p.alias("p"), F.max("latency_ms").alias("max_latency"), F.avg(F.col("is_error").cast("double")).alias("error_rate")
    )
    names = ("p50", "p95", "p99")
    return out.select("*", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(names))).drop("p").withColumn("error_rate", F.round("error_rate", 8))


def breakdown(traces: DataFrame, dimension: str) -> DataFrame:
    """Cost by one dimension with its share of the total."""
    grouped = traces.groupBy(F.col(dimension).alias("value")).agg(F.sum("cost_micros").alias("cost_micros"), F.count("*").alias("requests"))
    total = grouped.agg(F.sum("cost_micros").alias("total"))
    return grouped.join(F.broadcast(total)).select("value", "cost_micros", "requests", F.round(100.0 * F.col("cost_micros") / F.col("total"), 6).alias("percent"))


def breakdowns(traces: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Cost by each of several dimensions in one pass, with the share of the total."""
    out = traces.groupingSets([[F.col(d)] for d in dimensions], *(F.col(d) for d in dimensions)).agg(
        F.sum("cost_micros").alias("cost_micros"), F.count("*").alias("requests"), *(F.grouping(d).alias(f"_{d}") for d in dimensions)
    )
    name = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dimensions))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dimensions))
    whole = traces.agg(F.sum("cost_micros").alias("total"))
    return out.join(F.broadcast(whole)).select(name.alias("dimension"), value.alias("value"), "cost_micros", "requests", F.round(100.0 * F.col("cost_micros") / F.col("total"), 6).alias("percent"))


def cost_summary(traces: DataFrame) -> DataFrame:
    """Total cost, requests, tokens, cost a request, and the most costly model, in one row."""
    by_model = traces.groupBy("model_id").agg(F.sum("cost_micros").alias("c"), F.count("*").alias("n"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"))
    return by_model.agg(
        F.sum("c").alias("cost_micros"),
        F.sum("n").alias("requests"),
        F.sum("t").alias("tokens"),
        F.round(F.sum("c") / F.sum("n"), 6).alias("cost_per_request"),
        F.max_by("model_id", F.struct("c", "model_id")).alias("top_model"),
    )


def hourly_costs(traces: DataFrame) -> DataFrame:
    return traces.groupBy(hour().alias("hour"), "model_id", "user_id", "feature_id", "environment").agg(
        F.count("*").alias("requests"), F.sum("cost_micros").alias("cost_micros"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    )


def timeline(traces: DataFrame, period: str = "day") -> DataFrame:
    return traces.groupBy(F.date_trunc(period, "timestamp").cast("timestamp_ntz").alias("bucket")).agg(
        F.sum("cost_micros").alias("cost_micros"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("requests")
    )


def metric_query(traces: DataFrame, metric: str, aggregate: str, group_by: Sequence[str], period: str | None = None) -> DataFrame:
    """One aggregate of one metric by keys, and by period if one is given."""
    keys = [F.col(k) for k in group_by]
    if period:
        keys.insert(0, F.date_trunc(period, "timestamp").cast("timestamp_ntz").alias("bucket"))
    return traces.groupBy(*keys).agg(F.round(AGGREGATES[aggregate](F.col(metric)), 6).alias("metric_value"))


def trace_page(traces: DataFrame, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, at most 1000 rows a page; ties by trace."""
    rows = traces if where is None else traces.where(where)
    return rows.orderBy(F.desc("timestamp"), "trace_id").offset(offset).limit(min(limit, 1000))


def trace_stats(traces: DataFrame) -> DataFrame:
    """Totals and a map of requests by model, in one row."""
    by_model = traces.groupBy("model_id").agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("e"), F.sum("latency_ms").alias("l"), F.sum("cost_micros").alias("c")
    )
    top = by_model.agg(
        F.sum("n").alias("total"),
        F.round(F.sum("e") / F.sum("n"), 8).alias("error_rate"),
        F.round(F.sum("l") / F.sum("n"), 6).alias("avg_latency"),
        F.sum("c").alias("cost_micros"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "model_id", "n"))), ",").alias("by_model"),
    )
    p95 = traces.agg(F.round(F.percentile("latency_ms", 0.95), 6).alias("p95_latency"))
    return top.join(F.broadcast(p95))


def compare(traces: DataFrame, left: str, right: str) -> DataFrame:
    """Differences of two traces in duration, cost and tokens, absolute and in percent."""
    long = traces.where(F.col("trace_id").isin(left, right)).select("trace_id", F.col("latency_ms").cast("double"), F.col("cost_micros").cast("double"), F.col("input_tokens").cast("double"))
    long = long.unpivot("trace_id", ["latency_ms", "cost_micros", "input_tokens"], "measure", "amount")
    side = lambda t: F.max(F.when(F.col("trace_id") == t, F.col("amount")))
    out = long.groupBy("measure").agg(side(left).alias("left_value"), side(right).alias("right_value"))
    delta = F.col("right_value") - F.col("left_value")
    return out.select("*", F.round(delta, 6).alias("delta"), F.round(100 * F.try_divide(delta, F.col("left_value")), 6).alias("percent"))


def model_health(traces: DataFrame, evaluations: DataFrame, days: int = 7) -> DataFrame:
    """Last days by model: requests, errors, latency, cost and mean scores."""
    last = traces.agg(F.max("timestamp").alias("as_of"))
    recent = traces.join(F.broadcast(last)).where(F.expr(f"timestamp >= as_of - INTERVAL {days} DAYS"))
    stats = recent.groupBy("model_id").agg(
        F.count("*").alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.round(F.percentile("latency_ms", 0.95), 6).alias("p95_latency"),
        F.sum("cost_micros").alias("cost_micros"),
    )
    scores = evaluations.groupBy("model_id").agg(F.round(F.avg(F.when(F.col("score") >= 0, F.col("score"))), 8).alias("avg_score"))
    return stats.join(scores, "model_id", "left").withColumn("error_rate", F.round(F.col("errors") / F.col("requests"), 8))


def evaluation_summary(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy(day().alias("day"), "model_id", "evaluator").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "warn", "fail")),
        F.round(F.avg("score"), 8).alias("avg_score"),
    )


def evaluation_trends(evaluations: DataFrame) -> DataFrame:
    """Daily mean score of each evaluator and its change against the day before."""
    daily = evaluations.groupBy("evaluator", day().alias("day")).agg(F.avg("score").alias("s"), F.count("*").alias("n"))
    before = F.lag("s").over(Window.partitionBy("evaluator").orderBy("day"))
    return daily.select("evaluator", "day", "n", F.round("s", 8).alias("avg_score"), F.round(F.col("s") - before, 8).alias("change"))


def slice_metrics(traces: DataFrame, dimension: Column, least: int = 100) -> DataFrame:
    """All slice metrics by one dimension, for slices that are large enough."""
    whole = ("total_cost", "token_usage", "n")
    metrics = [(m if n in whole else F.round(m, 8)).alias(n) for n, m in slice_metrics_of().items()]
    return traces.groupBy(dimension.cast("string").alias("slice")).agg(*metrics).where(F.col("n") >= least)


def slice_grouping_sets(traces: DataFrame, least: int = 100) -> DataFrame:
    """Error rate and latency over several dimensions at once, in one pass."""
    base = traces.withColumns({"hour_of_day": F.hour("timestamp").cast("string"), "weekday": (F.weekday("timestamp") + 1).cast("string")})
    dims = ["model_id", "service_name", "hour_of_day", "weekday"]
    sets = [[F.col(d)] for d in dims]
    out = base.groupingSets(sets, *(F.col(d) for d in dims)).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("is_error").cast("double")), 8).alias("error_rate"), F.round(F.avg("latency_ms"), 6).alias("avg_latency")
    )
    return out.where(F.col("n") >= least)


#: Slice dimensions and their columns or expressions.
DIMENSIONS = {
    "model": "model_id",
    "user": "user_id",
    "feature": "feature_id",
    "input_length": "input_tokens",
    "output_length": "output_tokens",
    "latency": "floor(latency_ms / 10)",
    "time_of_day": "hour(timestamp)",
    "day_of_week": "weekday(timestamp) + 1",
    "prompt_template": "prompt_template",
    "provider": "provider",
    "environment": "environment",
}


def slices(traces: DataFrame, least: int = 100) -> DataFrame:
    """All slice metrics over all dimensions, in one pass, for slices that are large enough."""
    names = list(DIMENSIONS)
    base = traces.select("*", *(F.expr(e).cast("string").alias(f"_{d}") for d, e in DIMENSIONS.items()))
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    out = base.groupingSets([[F.col(f"_{d}")] for d in names], *(F.col(f"_{d}") for d in names)).agg(
        F.count("*").alias("n"),
        share(F.col("is_error")).alias("error_rate"),
        p.alias("_p"),
        F.sum("cost_micros").alias("cost"),
        F.round(F.avg(F.col("input_tokens") + F.col("output_tokens")), 6).alias("token_usage"),
        share(F.col("toxicity_score") > 0.5).alias("toxicity_rate"),
        share(F.col("hallucination_score") > 0.5).alias("hallucination_rate"),
        F.round(F.avg("drift_score"), 6).alias("drift_score"),
        *(F.grouping(f"_{d}").alias(f"g_{d}") for d in names),
    )
    name = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in names))
    value = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.col(f"_{d}")) for d in names))
    latencies = [F.round(F.col("_p")[i], 6).alias(n) for i, n in enumerate(("latency_p50", "latency_p95", "latency_p99"))]
    rest = ("error_rate", "cost", "token_usage", "toxicity_rate", "hallucination_rate", "drift_score")
    return out.where(F.col("n") >= least).select(name.alias("dimension"), value.alias("slice"), "n", *latencies, *rest)


def slices_against_baseline(traces: DataFrame, dimension: str, hours: int, least: int = 20) -> DataFrame:
    """Error rate of each slice in the last hours against its own over seven times as long before the newest row."""
    newest = traces.agg(F.max("timestamp").alias("as_of"))
    rows = traces.join(F.broadcast(newest)).where(F.expr(f"timestamp > as_of - INTERVAL {7 * hours} HOURS"))
    late = F.expr(f"timestamp > as_of - INTERVAL {hours} HOURS")
    error = F.col("is_error").cast("double")
    out = rows.groupBy(F.col(dimension).alias("slice")).agg(F.count_if(late).alias("n"), F.avg(F.when(late, error)).alias("rate"), F.avg(error).alias("base"))
    deviation = F.try_divide(F.col("rate") - F.col("base"), F.col("base"))
    return out.where(F.col("n") >= least).select("slice", "n", F.round("rate", 8).alias("rate"), F.round("base", 8).alias("baseline"), F.round(deviation, 8).alias("deviation"))


def with_evaluations(traces: DataFrame, evaluations: DataFrame, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Traces, or spans, with how many evaluations they have, their mean score and how many failed; none gives 0 and null.

    ``keys`` are trace_id, or trace_id and span_id.
    """
    own = evaluations.groupBy(*keys).agg(F.count("*").alias("n_evaluations"), F.round(F.avg("score"), 8).alias("avg_score"), F.count_if(F.col("verdict") == "fail").alias("n_failed"))
    out = traces.join(own, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_evaluations", "n_failed")})


def failures_with_traces(failures: DataFrame, traces: DataFrame, names: tuple[str, ...] = ("service_name", "provider", "latency_ms", "cost_micros")) -> DataFrame:
    """Failures with columns of their traces; a failure whose trace is gone has nulls."""
    own = traces.select("trace_id", *names).dropDuplicates(["trace_id"])
    return failures.join(own, "trace_id", "left")


#: Metrics by which slices are held against all rows, and whether more is worse.
SLICE_METRICS = {"error_rate": ("is_error", 1), "latency": ("latency_ms", 1), "cost": ("cost_micros", 1), "toxicity": ("toxicity_score", 1), "hallucination": ("hallucination_score", 1)}


def worst_slices(traces: DataFrame, dimensions: list[str], least: int = 50, deviation: float = 0.1, most: int = 10) -> DataFrame:
    """(dimension, slice, metric, n, value, deviation, impact): where any metric is worse than over all rows.

    All dimensions and metrics come from one pass: a row counts once for each dimension, in partial sums.
    """
    metrics = {m: way for m, way in SLICE_METRICS.items() if way[0] in traces.columns}
    means = lambda: [F.avg(F.col(c).cast("double")).alias(m) for m, (c, _) in metrics.items()]
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dimensions), F.struct(F.lit("").alias("dimension"), F.lit("").alias("slice"))))
    rows = traces.select(each.alias("d"), *(c for c, _ in metrics.values())).groupBy("d.dimension", "d.slice").agg(F.count("*").alias("n"), *means())
    long = rows.unpivot(["dimension", "slice", "n"], list(metrics), "metric", "value")
    base = long.where("dimension = ''").select("metric", F.col("value").alias("base"))  # one row a metric
    worse = reduce(lambda w, m: w.when(F.col("metric") == m[0], m[1][1]), metrics.items(), F)
    out = long.where(F.col("dimension") != "").where(F.col("n") >= least).join(F.broadcast(base), "metric")
    out = out.withColumn("dev", worse * F.try_divide(F.col("value") - F.col("base"), F.abs("base"))).where(F.col("dev") >= deviation)
    impact = F.round(F.col("dev") * F.log(F.col("n") + 1), 8)
    return out.select("dimension", "slice", "metric", "n", F.round("value", 8).alias("value"), F.round("dev", 8).alias("deviation"), impact.alias("impact")).orderBy(F.desc("impact"), "dimension", "slice", "metric").limit(most)


def of_models(rows: DataFrame, models: list[str]) -> DataFrame:
    """Rows of these models, all where none is named; a row without a model is of the model ``default``."""
    named = rows.withColumn("model_id", default_model(F.col("model_id")))
    return named.where(F.col("model_id").isin(models)) if models else named


def default_model(model: Column) -> Column:
    return F.coalesce(F.nullif(model, F.lit("")), F.lit("default"))


def quick_analysis(traces: DataFrame, dimensions: list[str], hours: int = 6, least: int = 5) -> DataFrame:
    """The worst slices of each model in its table's last hours, as one row: how many there are, and the worst."""
    newest = traces.agg(F.max("timestamp").alias("_newest"))
    late = traces.join(F.broadcast(newest)).where(F.expr(f"timestamp >= _newest - INTERVAL {hours} HOURS"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dimensions)))
    error = F.avg(F.col("is_error").cast("double"))
    rows = late.select("model_id", "is_error", each.alias("d")).groupBy("model_id", "d.dimension", "d.slice").agg(F.count("*").alias("n"), error.alias("rate"))
    base = late.groupBy("model_id").agg(error.alias("base"))
    rows = rows.where(F.col("n") >= least).join(base, "model_id").withColumn("dev", F.try_divide(F.col("rate") - F.col("base"), F.col("base"))).where(F.col("dev") >= 0.1)
    name = F.concat_ws("=", "dimension", "slice")
    found = rows.groupBy("model_id").agg(F.count("*").alias("slices"), F.max_by(F.struct(name.alias("name"), "dev"), F.struct("dev", "n", name)).alias("top"))
    summary = F.when(F.col("slices").isNull(), "nothing stands out").otherwise(F.format_string("%d slices stand out, most of all %s", "slices", "top.name"))
    return base.join(found, "model_id", "left").select("model_id", F.coalesce("slices", F.lit(0)).alias("slices"), F.col("top.name").alias("worst"), F.round("top.dev", 8).alias("severity"), summary.alias("summary"))


def hourly_quality(traces: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Error rate, p95 latency and mean score of each hour."""
    calls = traces.groupBy(hour().alias("hour")).agg(F.round(F.avg(F.col("is_error").cast("double")), 8).alias("error_rate"), F.round(F.percentile("latency_ms", 0.95), 6).alias("p95_latency"))
    scores = evaluations.groupBy(hour().alias("hour")).agg(F.round(F.avg("score"), 8).alias("quality"))
    return calls.join(scores, "hour", "left")


def trace_page_with_total(traces: DataFrame, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """:func:`trace_page` with the number of all rows that the filter lets through."""
    rows = traces if where is None else traces.where(where)
    return trace_page(traces, where, limit, offset).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def system_health(models: DataFrame) -> DataFrame:
    """(model_id, health, drift, alerts), the latest of each model: mean health, models that drift, all alerts."""
    return models.agg(F.round(F.avg("health"), 8).alias("health"), F.count_if("drift").alias("drifted"), F.sum("alerts").alias("alerts"), F.count("*").alias("models"))


def unexpired(rows: DataFrame, days: int, column: str = "timestamp") -> DataFrame:
    """Rows of the last days before the newest; what is older has expired."""
    newest = rows.agg(F.max(column).alias("_newest"))
    return rows.join(F.broadcast(newest)).where(F.expr(f"`{column}` > _newest - INTERVAL {days} DAYS")).drop("_newest")


#: How long a parameter may be, and which statuses and dimensions there are.
MOST_CHARACTERS = 256
STATUSES = ("ok", "error", "timeout", "cancelled", "unknown")
COST_DIMENSIONS = ("model", "user", "feature", "service", "environment", "provider")


def valid_identifier(c: Column) -> Column:
    return F.coalesce(F.length(c).between(1, MOST_CHARACTERS) & c.rlike(r"\A[a-zA-Z0-9_.\-]+\z"), F.lit(False))


def valid_time(c: Column) -> Column:
    """A date, or a date and time with an optional fraction and zone."""
    return F.coalesce((F.length(c) <= 30) & c.rlike(r"\A\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?\z"), F.lit(False))


def valid_status(c: Column) -> Column:
    return F.coalesce(c.isin(*STATUSES), F.lit(False))


def preview(c: Column, most: int = 1000) -> Column:
    return F.left(c, F.lit(most))


def slice_impact(traces: DataFrame, dimension: str, least: int = 50, deviation: float = 0.1, most: int = 50) -> DataFrame:
    """Slices whose error rate is off the baseline: deviation, an approximate p-value, interval and impact."""
    base = traces.agg(F.avg(F.col("is_error").cast("double")).alias("base"), F.count("*").alias("total"))
    rows = traces.groupBy(F.col(dimension).alias("slice")).agg(F.count("*").alias("n"), F.avg(F.col("is_error").cast("double")).alias("rate")).where(F.col("n") >= least)
    rows = rows.join(F.broadcast(base)).withColumn("dev", F.try_divide(F.col("rate") - F.col("base"), F.col("base")))
    margin = 1.96 * F.col("base") / F.sqrt("n")
    return (
        rows.where(F.abs("dev") >= deviation)
        .select(
            "slice",
            "n",
            F.round("rate", 8).alias("rate"),
            F.round("dev", 8).alias("deviation"),
            F.round(F.exp(-10 * F.abs("dev") * (F.col("n") / F.col("total"))), 8).alias("p_value"),
            F.round(F.col("rate") - margin, 8).alias("low"),
            F.round(F.col("rate") + margin, 8).alias("high"),
            F.round(F.abs("dev") * F.log(F.col("n") + 1), 8).alias("impact"),
        )
        .orderBy(F.desc("impact"), "slice")
        .limit(most)
    )


def suggested_bins(traces: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Quantiles at i / bins."""
    edges = F.percentile(column, F.array(*(F.lit(i / bins) for i in range(1, bins))))
    return traces.agg(edges.alias("e")).select(F.posexplode("e").alias("k", "edge")).select((F.col("k") + 1).cast("long").alias("k"), F.round("edge", 6).alias("edge"))


def against_baseline(traces: DataFrame, metric: Column, factor: float) -> DataFrame:
    """Hours whose metric is ``factor`` times the mean of all earlier hours, or more."""
    hourly = traces.groupBy(hour().alias("hour")).agg(metric.alias("m"))
    before = F.avg("m").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    rows = hourly.withColumn("b", before).where((F.col("b") > 0) & (F.col("m") >= factor * F.col("b")))
    return rows.select("hour", F.round("m", 8).alias("metric_value"), F.round("b", 8).alias("baseline"))


def histogram(traces: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets of a client histogram, the last without a bound; a value that equals a bound falls in the next bucket."""
    bounds = [*bounds, math.inf]
    counts = [(F.count(column) if math.isinf(b) else F.count_if(F.col(column) < b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = traces.agg(*counts, F.count(column).alias("total"), F.round(F.sum(column), 4).alias("total_sum"))
    le = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)))
    return row.select(F.explode(le).alias("x"), "total", "total_sum").select("x.le", "x.cumulative", "total", "total_sum")
