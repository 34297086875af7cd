"""Rollups, breakdowns, lists and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import rollups as R
from spanloom.plans import filters, search
from spanloom.sources import views as V

_T = V.with_views(V.TRACES_SQL)
_E = V.with_views(V.EVALUATIONS_SQL)
_TE = V.with_views(V.TRACES_SQL, V.EVALUATIONS_SQL)
_A = V.with_views(V.DRIFT_ALERTS_SQL)

_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0)
_SEARCH = "service:click status:ok duration:>20 duration:<80 time:last-48h model:model_1"
_FILTER = "latency_ms >= 10 AND service_name IN (click, view) AND input_tokens BETWEEN 10 AND 60 AND user_id NOT LIKE user_1%"


def _severity(df):
    order = F.element_at(F.create_map(*(F.lit(x) for kv in (("low", 1), ("medium", 2), ("high", 3), ("critical", 4)) for x in kv)), F.col("severity"))
    return df.withColumn("severity_rank", order)


def active_alerts(s, d):
    rows = _severity(V.drift_alerts(s, d)).where("status = 'open' and severity_rank >= 3")
    return rows.orderBy(F.desc("severity_rank"), F.desc("detected_at"), "alert_id").limit(100)


def drift_heatmap(s, d):
    models = [f"model_{i}" for i in range(5)]
    return V.drift_alerts(s, d).groupBy("feature").pivot("model_id", models).agg(F.max("score"))


def drift_timeline(s, d):
    kinds = ["feature", "embedding", "concept", "prediction"]
    return V.drift_alerts(s, d).groupBy(R.day("detected_at").alias("day")).pivot("drift_type", kinds).agg(F.round(F.avg("score"), 6))


def drift_alert_counts(s, d):
    return V.drift_alerts(s, d).groupBy(R.day("detected_at").alias("day"), "model_id", "drift_type", "severity").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "resolved").alias("n_resolved")
    )


def new_failure_modes(s, d):
    rows = V.failures(s, d).withColumn("mode", F.concat_ws("/", "failure_type", "user_id"))
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    history = rows.where(F.col("timestamp") < cut).select("mode").distinct()
    return rows.where(F.col("timestamp") >= cut).join(history, "mode", "left_anti").groupBy("mode").agg(F.count("*").alias("n"))


def cost_forecast(s, d):
    """Run rate of the last month, carried on to its end."""
    t = V.traces(s, d)
    edge = t.agg(F.max("timestamp").alias("as_of")).withColumn("start", F.date_trunc("month", "as_of").cast("timestamp_ntz"))
    spend = t.join(F.broadcast(edge)).where("timestamp >= start").groupBy("start", "as_of").agg(F.sum("cost_micros").alias("spend"))
    elapsed = F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return spend.select("spend", F.round(F.col("spend") / (elapsed / 1e6) * (30 * 86400), 2).alias("forecast"))


QUERIES = {
    "traces_hourly": lambda s, d: R.traces_hourly(V.traces(s, d)),
    "daily_costs": lambda s, d: R.daily_costs(V.traces(s, d)),
    "cost_period_rollup": lambda s, d: R.period_rollup(V.traces(s, d), "hour"),
    "cost_breakdown": lambda s, d: R.breakdown(V.traces(s, d), "provider"),
    "cost_timeline": lambda s, d: R.timeline(V.traces(s, d)),
    "cost_forecast": cost_forecast,
    "metric_query_p95": lambda s, d: R.metric_query(V.traces(s, d), "latency_ms", "p95", ["model_id", "service_name"], "day"),
    "trace_list": lambda s, d: R.trace_page(V.traces(s, d), (F.col("model_id") == "model_2") & (F.col("status") == "ok"), 50, 20),
    "trace_lookup": lambda s, d: V.traces(s, d).where(F.col("trace_id") == "77"),
    "trace_search": lambda s, d: search.search(V.traces(s, d), _SEARCH).select("trace_id", "timestamp", "latency_ms"),
    "trace_filter_expr": lambda s, d: V.traces(s, d).where(filters.parse(_FILTER)).select("trace_id", "latency_ms", "user_id", "input_tokens"),
    "trace_stats": lambda s, d: R.trace_stats(V.traces(s, d)),
    "trace_compare": lambda s, d: R.compare(V.traces(s, d), "5", "17"),
    "model_health": lambda s, d: R.model_health(V.traces(s, d), V.evaluations(s, d)),
    "eval_summary": lambda s, d: R.evaluation_summary(V.evaluations(s, d)),
    "eval_trends": lambda s, d: R.evaluation_trends(V.evaluations(s, d)),
    "slice_metrics": lambda s, d: R.slice_metrics(V.traces(s, d), F.col("model_id")),
    "slice_by_input_length": lambda s, d: R.slice_metrics(
        V.traces(s, d), F.when(F.col("input_tokens") < 25, "short").when(F.col("input_tokens") <= 75, "medium").otherwise("long")
    ),
    "slice_grouping_sets": lambda s, d: R.slice_grouping_sets(V.traces(s, d)),
    "slice_impact": lambda s, d: R.slice_impact(V.traces(s, d), "user_id"),
    "suggested_bins": lambda s, d: R.suggested_bins(V.traces(s, d), "latency_ms"),
    "dimension_values": lambda s, d: V.traces(s, d).select("user_id").distinct().orderBy("user_id").limit(100),
    "error_by_hour_of_day": lambda s, d: V.traces(s, d).groupBy(F.hour("timestamp").cast("long").alias("hour_of_day")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("is_error").cast("double")), 8).alias("error_rate")
    ),
    "error_spikes": lambda s, d: R.against_baseline(V.traces(s, d), F.avg(F.col("is_error").cast("double")), 2.0),
    "latency_degradation": lambda s, d: R.against_baseline(V.traces(s, d), F.percentile("latency_ms", 0.95), 1.5),
    "client_histogram": lambda s, d: R.histogram(V.traces(s, d), "latency_ms", _BOUNDS),
    "active_drift_alerts": active_alerts,
    "drift_heatmap": drift_heatmap,
    "drift_timeline": drift_timeline,
    "drift_alert_counts": drift_alert_counts,
    "new_failure_modes": new_failure_modes,
}

_SLICES = """round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate, round(avg(latency_ms), 8) AS avg_latency,
  round(quantile_cont(latency_ms, 0.95), 8) AS p95_latency, CAST(sum(cost_micros) AS BIGINT) AS total_cost,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS token_usage, count(*) AS n"""


def _baseline(metric: str, factor: float) -> str:
    return f"""{_T} SELECT hour, round(m, 8) AS metric_value, round(b, 8) AS baseline FROM (
      SELECT *, avg(m) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (
        SELECT date_trunc('hour', "timestamp") AS hour, {metric} AS m FROM traces GROUP BY 1)) WHERE b > 0 AND m >= {factor} * b"""


ORACLE_SQL = {
    "traces_hourly": f"""{_T} SELECT date_trunc('hour', "timestamp") AS hour, service_name, model_id, provider, count(*) AS n,
      CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      CAST(sum(cost_micros) AS BIGINT) AS cost_micros, round(sum(latency_ms), 4) AS latency_sum, count(*) FILTER (is_error) AS errors
      FROM traces GROUP BY ALL""",
    "daily_costs": f"""{_T} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, model_id, provider, service_name, user_id, count(*) AS requests,
      CAST(sum(cost_micros) AS BIGINT) AS cost_micros, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM traces GROUP BY ALL""",
    "cost_period_rollup": f"""{_T} SELECT date_trunc('hour', "timestamp") AS period_start, service_name, model_id, count(*) AS requests,
      max(latency_ms) AS max_latency, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
      round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM traces GROUP BY ALL""",
    "cost_breakdown": f"""{_T} SELECT provider AS "value", CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) AS requests,
      round(100.0::DOUBLE * sum(cost_micros) / (SELECT sum(cost_micros) FROM traces), 6) AS percent FROM traces GROUP BY 1""",
    "cost_timeline": f"""{_T} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS bucket, CAST(sum(cost_micros) AS BIGINT) AS cost_micros,
      CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS requests FROM traces GROUP BY 1""",
    "cost_forecast": f"""{_T}, edge AS (SELECT max("timestamp") AS as_of, date_trunc('month', max("timestamp"))::TIMESTAMP AS start FROM traces)
      SELECT CAST(sum(cost_micros) AS BIGINT) AS spend,
      round(CAST(sum(cost_micros) AS BIGINT) / ((epoch_us(any_value(as_of)) - epoch_us(any_value(start))) / 1e6) * (30 * 86400), 2) AS forecast
      FROM traces, edge WHERE "timestamp" >= start""",
    "metric_query_p95": f"""{_T} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS bucket, model_id, service_name,
      round(quantile_cont(latency_ms, 0.95), 6) AS metric_value FROM traces GROUP BY ALL""",
    "trace_list": f"""{_T} SELECT * FROM traces WHERE model_id = 'model_2' AND status = 'ok' ORDER BY "timestamp" DESC, trace_id LIMIT 50 OFFSET 20""",
    "trace_lookup": f"{_T} SELECT * FROM traces WHERE trace_id = '77'",
    "trace_search": f"""{_T} SELECT trace_id, "timestamp", latency_ms FROM traces WHERE service_name = 'click' AND status = 'ok' AND latency_ms > 20
      AND latency_ms < 80 AND model_id = 'model_1' AND "timestamp" >= (SELECT max("timestamp") FROM traces) - INTERVAL 48 HOURS""",
    "trace_filter_expr": f"""{_T} SELECT trace_id, latency_ms, user_id, input_tokens FROM traces WHERE latency_ms >= 10
      AND service_name IN ('click', 'view') AND input_tokens BETWEEN 10 AND 60 AND user_id NOT LIKE 'user_1%'""",
    "trace_stats": f"""{_T} SELECT count(*) AS total, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate, round(sum(latency_ms) / count(*), 6) AS avg_latency,
      CAST(sum(cost_micros) AS BIGINT) AS cost_micros, (SELECT string_agg(model_id || ':' || n, ',' ORDER BY model_id || ':' || n) FROM
      (SELECT model_id, count(*) AS n FROM traces GROUP BY 1)) AS by_model, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency FROM traces""",
    "trace_compare": f"""{_T} SELECT measure, l AS left_value, r AS right_value, round(r - l, 6) AS delta, round(100 * (r - l) / nullif(l, 0), 6) AS percent FROM (
      SELECT measure, max(CASE WHEN trace_id = '5' THEN amount END) AS l, max(CASE WHEN trace_id = '17' THEN amount END) AS r FROM (
        SELECT trace_id, 'latency_ms' AS measure, latency_ms::DOUBLE AS amount FROM traces
        UNION ALL SELECT trace_id, 'cost_micros', cost_micros::DOUBLE FROM traces
        UNION ALL SELECT trace_id, 'input_tokens', input_tokens::DOUBLE FROM traces) WHERE trace_id IN ('5', '17') GROUP BY 1)""",
    "model_health": f"""{_TE} SELECT t.*, round(errors / requests, 8) AS error_rate, e.avg_score FROM (
      SELECT model_id, count(*) AS requests, count(*) FILTER (is_error) AS errors, round(avg(latency_ms), 6) AS avg_latency,
        round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM traces
      WHERE "timestamp" >= (SELECT max("timestamp") FROM traces) - INTERVAL 7 DAYS GROUP BY 1) t
      LEFT JOIN (SELECT model_id, round(avg(score) FILTER (score >= 0), 8) AS avg_score FROM evaluations GROUP BY 1) e USING (model_id)""",
    "eval_summary": f"""{_E} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, model_id, evaluator, count(*) AS n, count(*) FILTER (verdict = 'pass') AS n_pass,
      count(*) FILTER (verdict = 'warn') AS n_warn, count(*) FILTER (verdict = 'fail') AS n_fail, round(avg(score), 8) AS avg_score FROM evaluations GROUP BY ALL""",
    "eval_trends": f"""{_E} SELECT evaluator, day, n, round(s, 8) AS avg_score, round(s - lag(s) OVER (PARTITION BY evaluator ORDER BY day), 8) AS change FROM (
      SELECT evaluator, date_trunc('day', "timestamp")::TIMESTAMP AS day, avg(score) AS s, count(*) AS n FROM evaluations GROUP BY ALL)""",
    "slice_metrics": f"{_T} SELECT model_id AS slice, {_SLICES} FROM traces GROUP BY 1 HAVING count(*) >= 100",
    "slice_by_input_length": f"""{_T} SELECT CASE WHEN input_tokens < 25 THEN 'short' WHEN input_tokens <= 75 THEN 'medium' ELSE 'long' END AS slice, {_SLICES}
      FROM traces GROUP BY 1 HAVING count(*) >= 100""",
    "slice_grouping_sets": f"""{_T} SELECT model_id, service_name, hour_of_day, weekday, count(*) AS n, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate,
      round(avg(latency_ms), 6) AS avg_latency FROM (SELECT *, CAST(hour("timestamp") AS VARCHAR) AS hour_of_day, CAST(isodow("timestamp") AS VARCHAR) AS weekday FROM traces)
      GROUP BY GROUPING SETS ((model_id), (service_name), (hour_of_day), (weekday)) HAVING count(*) >= 100""",
    "slice_impact": f"""{_T}, base AS (SELECT avg(CAST(is_error AS DOUBLE)) AS base, count(*) AS total FROM traces),
      s AS (SELECT user_id AS slice, count(*) AS n, avg(CAST(is_error AS DOUBLE)) AS rate FROM traces GROUP BY 1 HAVING count(*) >= 50)
      SELECT slice, n, round(rate, 8) AS rate, round(dev, 8) AS deviation, round(exp(-10 * abs(dev) * (n / total)), 8) AS p_value,
        round(rate - 1.96 * base / sqrt(n), 8) AS low, round(rate + 1.96 * base / sqrt(n), 8) AS high, round(abs(dev) * ln(n + 1), 8) AS impact
      FROM (SELECT *, (rate - base) / nullif(base, 0) AS dev FROM s, base) WHERE abs(dev) >= 0.1 ORDER BY impact DESC, slice LIMIT 50""",
    "suggested_bins": f"""{_T}, q AS (SELECT quantile_cont(latency_ms, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM traces)
      SELECT CAST(k AS BIGINT) AS k, round(e[k], 6) AS edge FROM q, range(1, 10) r(k)""",
    "dimension_values": f"{_T} SELECT DISTINCT user_id FROM traces ORDER BY user_id LIMIT 100",
    "error_by_hour_of_day": f"""{_T} SELECT CAST(hour("timestamp") AS BIGINT) AS hour_of_day, count(*) AS n, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate
      FROM traces GROUP BY 1""",
    "error_spikes": _baseline("avg(CAST(is_error AS DOUBLE))", 2.0),
    "latency_degradation": _baseline("quantile_cont(latency_ms, 0.95)", 1.5),
    "client_histogram": f"""{_T} SELECT le, (SELECT count(*) FROM traces WHERE latency_ms < le OR isinf(le)) AS cumulative, (SELECT count(latency_ms) FROM traces) AS total,
      (SELECT round(sum(latency_ms), 4) FROM traces) AS total_sum FROM (SELECT unnest([1.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE, 50.0::DOUBLE, 100.0::DOUBLE, 'inf'::DOUBLE]) AS le)""",
    "active_drift_alerts": f"""{_A} SELECT *, CAST(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS INTEGER) AS severity_rank
      FROM drift_alerts WHERE status = 'open' AND severity IN ('high', 'critical') ORDER BY severity_rank DESC, detected_at DESC, alert_id LIMIT 100""",
    "drift_heatmap": f"""{_A} SELECT feature, {", ".join(f"max(score) FILTER (model_id = 'model_{i}') AS model_{i}" for i in range(5))} FROM drift_alerts GROUP BY 1""",
    "drift_timeline": f"""{_A} SELECT date_trunc('day', detected_at)::TIMESTAMP AS day, {", ".join(f"round(avg(score) FILTER (drift_type = '{k}'), 6) AS {k}" for k in ("feature", "embedding", "concept", "prediction"))}
      FROM drift_alerts GROUP BY 1""",
    "drift_alert_counts": f"""{_A} SELECT date_trunc('day', detected_at)::TIMESTAMP AS day, model_id, drift_type, severity, count(*) AS n,
      count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'resolved') AS n_resolved FROM drift_alerts GROUP BY ALL""",
    "new_failure_modes": f"""{V.with_views(V.TRACES_SQL, V.FAILURES_SQL)}, m AS (SELECT failure_type || '/' || user_id AS mode, "timestamp" AS ts FROM failures)
      SELECT mode, count(*) AS n FROM m WHERE ts >= TIMESTAMP '2024-01-24' AND mode NOT IN (SELECT mode FROM m WHERE ts < TIMESTAMP '2024-01-24') GROUP BY 1""",
}
