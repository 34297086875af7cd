"""Joins of traces with evaluations, cost views, all slices, alert pipelines, stored references, text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import alerts as A
from spanloom.operators import cost as C
from spanloom.operators import drift as D
from spanloom.operators import evals as E
from spanloom.operators import rca as R
from spanloom.operators import rollups
from spanloom.operators import sequential as S
from spanloom.queries.alerts import _ANOMALY, _EVENTS, _O, _events, _points
from spanloom.queries.drift import ORACLE_SQL as _DRIFT
from spanloom.queries.drift import _classes, _long
from spanloom.queries.rca import influence
from spanloom.sources import otlp
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)
_W = V.with_views(V.TRACES_SQL, V.WIDE_SQL)
_E = V.with_views(V.TRACES_SQL, V.EVALUATIONS_SQL)
_A = V.with_views(V.DRIFT_ALERTS_SQL)
_COSTS = {"model": "model_id", "user": "user_id", "feature": "feature_id", "service": "service_name", "environment": "environment", "provider": "provider"}
_BLOCKED, _ALLOWED = ["password", "secret token", "licence"], ["the"]


def cost_breakdowns(s, d):
    rows = V.wide_traces(s, d).select("cost_micros", *(F.col(c).alias(name) for name, c in _COSTS.items()))
    return rollups.breakdowns(rows, list(_COSTS))


def threshold_comparisons(s, d):
    """How often each comparison fires on three points in a row."""
    p = _points(s, d)
    parts = [A.threshold(p, 20.0, 2, name).agg(F.lit(name).alias("comparison"), F.count("*").alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seqs")) for name in A.COMPARISONS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_SQL_OPS = {">": "x > 20", ">=": "x >= 20", "<": "x < 20", "<=": "x <= 20", "==": "abs(x - 20) < 1e-9", "!=": "abs(x - 20) >= 1e-9"}
_STREAKS = " UNION ALL ".join(
    f"""SELECT '{name}' AS comparison, count(*) AS n, CAST(coalesce(sum(seq), 0) AS BIGINT) AS seqs FROM (SELECT *, count(*) FILTER ({test}) OVER (PARTITION BY key, island ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS streak
      FROM (SELECT *, count(*) FILTER (NOT ({test})) OVER (PARTITION BY key ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS island FROM p)) WHERE {test} AND streak >= 2"""
    for name, test in _SQL_OPS.items()
)


def anomaly_directions(s, d):
    p = _points(s, d)
    both = [A.anomaly(p, 2.0, 50, direction=way).withColumn("way", F.lit(way)) for way in ("up", "down")]
    return both[0].unionByName(both[1])


def alert_process(s, d):
    rows = [("2024-01-05 00:00:00", "2024-01-08 00:00:00", {"model": "model_1"})]
    times = lambda frame: frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
    silences = times(s.createDataFrame(rows, "start string, stop string, matchers map<string,string>"))
    works = times(s.createDataFrame([("2024-01-10 00:00:00", "2024-01-11 00:00:00", {"service": "error"})], silences.schema.simpleString()[7:-1].replace("timestamp_ntz", "string")))
    events = _events(s, d).withColumn("labels", F.create_map(F.lit("model"), "model_id", F.lit("service"), "service_name"))
    events = A.covered(A.covered(events, silences, "silenced"), works, "maintenance")
    return A.process(events.select(F.col("service_name").alias("key"), "timestamp", "seq", "fingerprint", "maintenance", "silenced"), 60, {3600.0: 2, 86400.0: 20})


def rate_limits(s, d):
    return S.rate_limits(_points(s, d), {3600.0: 2, 86400.0: 20})


def by_model(s, d):
    t = V.traces(s, d).select("model_id", F.col("latency_ms").alias("x"), "seq")
    return D.by_model(t.where("seq % 2 = 0"), t.where("seq % 2 = 1"), 0.01)


def system_health(s, d):
    alerts = V.drift_alerts(s, d).groupBy("model_id").agg(F.count_if(F.col("status") == "open").alias("alerts"), F.avg("score").alias("drift_score"))
    scores = V.evaluations(s, d).groupBy("model_id").agg(F.avg("score").alias("health"))
    models = scores.join(alerts, "model_id", "left").select("model_id", "health", F.coalesce(F.col("drift_score") > 40, F.lit(False)).alias("drift"), F.coalesce("alerts", F.lit(0)).alias("alerts"))
    return rollups.system_health(models)


def cluster_report(s, d):
    f = V.failures(s, d).withColumns({"cluster": F.regexp_extract("failure_type", "([0-9]+)", 1).cast("long"), "text": F.concat_ws(" ", F.lit("failure of"), "failure_type", F.lit("model"), F.translate("model_id", "_", ""))})
    out = R.describe_clusters(f.select("cluster", "text", "user_id", "timestamp"), 4)
    return out.withColumn("keywords", F.array_join("keywords", ","))


def cluster_assignment(s, d):
    clusters = s.createDataFrame([(1, "error at the first service today"), (2, "page not found on the second host")], "cluster long, representative string")
    texts = F.array(F.lit("Error at the first service, today!"), F.lit("page not found on second host"), F.lit("something else"), F.lit(None).cast("string"))
    rows = table(s, d, "events").select(F.col("event_id").alias("seq"), F.element_at(texts, (F.col("event_id") % 4 + 1).cast("int")).alias("text"))
    return R.assign_to_clusters(rows, clusters, 0.7).na.fill({"cluster": 0, "score": 0.0}).groupBy("cluster", "score").agg(F.count("*").alias("n"))


def triggers(s, d):
    a = V.drift_alerts(s, d).groupBy("model_id", "drift_type").agg((F.max("score") / 100).alias("severity"), F.avg("score").alias("m"))
    rows = a.select("model_id", "drift_type", (F.col("m") > 10).alias("drift"), "severity", (F.col("m") < 50).alias("safe"), (F.col("m") / 60).alias("risk"))
    return R.rca_triggers(rows).select("model_id", "drift_type", "why")


def fan_in(s, d):
    labels = V.evaluations(s, d).select(F.col("trace_id").alias("id"), "score", (F.col("verdict") != "fail").alias("passed"))
    return E.fan_in(labels.select("id", (1 - F.col("score") / 2).alias("score")), labels)


def spend_rate(s, d):
    """Money an hour of each model over the whole time, in micro-dollars."""
    hours = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 3_600_000_000
    return V.traces(s, d).groupBy("model_id").agg(F.sum("cost_micros").alias("cost_micros"), F.round(F.try_divide(F.sum("cost_micros"), hours), 6).alias("per_hour"))


def model_drift(s, d):
    """What GET of one model's drift shows: alerts by type, open ones, newest and worst."""
    a = V.drift_alerts(s, d).where("model_id = 'model_1'")
    return a.groupBy("model_id", "drift_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open"), F.max("detected_at").alias("last_at"), F.round(F.max("score"), 6).alias("worst"))


def token_sources(s, d):
    """Counts from headers and from attributes; a third of the events has neither."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    headers = F.create_map(F.lit("X-Prompt-Tokens"), F.when(i == 0, k), F.lit("x-completion-tokens"), F.when(i == 0, F.lit("9")))
    attributes = F.create_map(F.lit("gen_ai.usage.input_tokens"), F.when(i == 1, k), F.lit("llm.usage.completion_tokens"), F.when(i == 1, F.lit("4")))
    both = F.coalesce(C.tokens_from_headers(headers), C.tokens_from_attributes(attributes))
    return table(s, d, "events").select("event_id", both.alias("t")).where("t is not null").select("event_id", "t.*")


_BODIES = ['{"stop_reason": "end"}', '{"usageMetadata": {}}', '{"meta": {"billed_units": {"input_tokens": 1}}}', '{"usage": {"prompt_tokens": 1}}', '{"completion": "x"}', '{"model": "gpt-4o"}', "no json"]


def provider_bodies(s, d):
    bodies = F.array(*map(F.lit, _BODIES))
    hint = F.when(F.col("event_id") % 11 == 0, "claude-3-opus").when(F.col("event_id") % 11 == 1, "own-model")
    rows = table(s, d, "events").select(C.provider_from_body(F.element_at(bodies, (F.col("event_id") % 7 + 1).cast("int")), hint).alias("provider"))
    return rows.groupBy("provider").agg(F.count("*").alias("n"))


def _sent(s, d, build):
    e = table(s, d, "events").withColumn("ns", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"))
    service = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.concat(F.lit("svc"), F.col("event_id") % 4).alias("stringValue")).alias("value"))).alias("attributes"))
    return e.select(F.to_json(build(service)).alias("value"))


def metrics_intake(s, d):
    label = F.array(F.struct(F.lit("type").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value")))
    point = F.array(F.struct(label.alias("attributes"), F.col("ns").alias("timeUnixNano"), F.col("value").alias("asDouble")))
    whole = F.array(F.struct(F.col("ns").alias("timeUnixNano"), F.col("user_id").cast("string").alias("asInt")))
    both = lambda name, gauge, total: F.struct(F.lit(name).alias("name"), F.struct(gauge.alias("dataPoints")).alias("gauge"), F.struct(total.alias("dataPoints")).alias("sum"))
    metrics = F.array(both("latency", point, F.when(F.lit(False), whole)), both("user", F.when(F.lit(False), point), whole))
    build = lambda service: F.struct(F.array(F.struct(service.alias("resource"), F.array(F.struct(metrics.alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    rows = otlp.flatten_metrics(_sent(s, d, build))
    return rows.groupBy("service_name", "name", "kind", F.try_element_at("labels", F.lit("type")).alias("type")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"), F.max(F.col("time").cast("timestamp_ntz")).alias("last_at"))


def logs_intake(s, d):
    body = F.struct(F.col("event_type").alias("stringValue"))
    record = F.struct(F.col("ns").alias("timeUnixNano"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severityText"), body.alias("body"), F.col("event_id").cast("string").alias("traceId"))
    build = lambda service: F.struct(F.array(F.struct(service.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return otlp.flatten_logs(_sent(s, d, build)).select("trace_id", "service_name", "severity", "body", F.col("time").cast("timestamp_ntz").alias("at"))


QUERIES = {
    "token_sources": token_sources,
    "provider_from_body": provider_bodies,
    "metrics_intake": metrics_intake,
    "logs_intake": logs_intake,
    "traces_with_evaluations": lambda s, d: rollups.with_evaluations(V.traces(s, d), V.evaluations(s, d)).select("trace_id", "model_id", "status", "n_evaluations", "avg_score", "n_failed"),
    "trace_evaluations": lambda s, d: V.evaluations(s, d).join(F.broadcast(table(s, d, "labels").agg(F.min("doc_id").cast("string").alias("first"))), F.col("trace_id") == F.col("first")).select("trace_id", "evaluator", "verdict", "score"),
    "evaluation_page": lambda s, d: V.evaluations(s, d).orderBy(F.desc("timestamp"), F.desc("seq")).limit(50).select("trace_id", "timestamp", "model_id", "verdict", "score"),
    "trace_page_total": lambda s, d: rollups.trace_page_with_total(V.traces(s, d), F.col("is_error"), 20).select("trace_id", "timestamp", "latency_ms", "total"),
    "cost_summary": lambda s, d: rollups.cost_summary(V.traces(s, d)),
    "cost_breakdowns": cost_breakdowns,
    "cost_hourly": lambda s, d: rollups.hourly_costs(V.wide_traces(s, d)),
    "cost_spend_rate": spend_rate,
    "slices_all": lambda s, d: rollups.slices(V.wide_traces(s, d), 100),
    "slices_against_baseline": lambda s, d: rollups.slices_against_baseline(V.traces(s, d), "model_id", 48, 5),
    "hourly_quality": lambda s, d: rollups.hourly_quality(V.traces(s, d), V.evaluations(s, d)),
    "traces_unexpired": lambda s, d: rollups.unexpired(V.traces(s, d), 10).select("trace_id", "timestamp"),
    "system_health": system_health,
    "threshold_comparisons": threshold_comparisons,
    "anomaly_directions": anomaly_directions,
    "rate_percent": lambda s, d: A.rate(_points(s, d), 5.0, 600, True),
    "oscillation_rule": lambda s, d: A.oscillation(_points(s, d), 20, 10, 0.8),
    "alert_process": alert_process,
    "alert_rate_limits": rate_limits,
    "chi_square_test": lambda s, d: D.chi_square_test(_classes(s, d)),
    "drift_by_model": by_model,
    "drift_trend": lambda s, d: D.drift_trend(V.drift_alerts(s, d), 24),
    "drift_of_model": model_drift,
    "prompt_delimiters": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(E.delimiters(F.col("text")), ",").alias("delimiters")).where("delimiters <> ''"),
    "prompt_lists": lambda s, d: table(s, d, "documents").select("doc_id", E.listed(F.col("text"), _BLOCKED, _ALLOWED).alias("listed")),
    "evaluation_fan_in": fan_in,
    "failure_cluster_report": cluster_report,
    "failure_cluster_assignment": cluster_assignment,
    "rca_triggers": triggers,
    "critical_tokens": lambda s, d: R.critical_tokens(influence(s, d)),
}

_SLICES = " UNION ALL ".join(
    f"""SELECT '{name}' AS dimension, CAST({column} AS VARCHAR) AS slice, count(*) AS n, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50,
      round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99, CAST(sum(cost_micros) AS BIGINT) AS cost, round(avg(input_tokens + output_tokens), 6) AS token_usage,
      round(avg(CAST(toxicity_score > 0.5 AS DOUBLE)), 8) AS toxicity_rate, round(avg(CAST(hallucination_score > 0.5 AS DOUBLE)), 8) AS hallucination_rate, round(avg(drift_score), 6) AS drift_score
      FROM wide GROUP BY 2 HAVING count(*) >= 100"""
    for name, column in (
        rollups.DIMENSIONS
        | {"latency": "CAST(floor(latency_ms / 10) AS BIGINT)", "time_of_day": 'hour("timestamp")', "day_of_week": 'isodow("timestamp")'}
    ).items()
)
_TOTAL = "(SELECT sum(cost_micros) FROM wide)"
_TAIL = "0.5 * exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))"

ORACLE_SQL = {
    "token_sources": """SELECT event_id, k AS input_tokens, CASE event_id % 3 WHEN 0 THEN 9 ELSE 4 END::BIGINT AS output_tokens, k + CASE event_id % 3 WHEN 0 THEN 9 ELSE 4 END AS total_tokens
      FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE event_id % 3 < 2""",
    "provider_from_body": """SELECT CASE WHEN event_id % 11 = 0 THEN 'anthropic' ELSE (['anthropic', 'google', 'cohere', 'openai', 'bedrock', 'openai', 'unknown'])[CAST(event_id % 7 + 1 AS INTEGER)] END AS provider, count(*) AS n FROM events GROUP BY 1""",
    "metrics_intake": """WITH p AS (SELECT 'svc' || event_id % 4 AS service_name, 'latency' AS name, 'gauge' AS kind, event_type AS type, value AS v, ts FROM events
        UNION ALL SELECT 'svc' || event_id % 4, 'user', 'sum', NULL, user_id, ts FROM events)
      SELECT service_name, name, kind, type, count(*) AS n, round(sum(v), 4) AS total, max(ts) AS last_at FROM p GROUP BY ALL""",
    "logs_intake": """SELECT CAST(event_id AS VARCHAR) AS trace_id, 'svc' || event_id % 4 AS service_name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, event_type AS body, ts AS at FROM events""",
    "traces_with_evaluations": f"""{_E}, o AS (SELECT trace_id, count(*) AS n, round(avg(score), 8) AS s, count(*) FILTER (verdict = 'fail') AS f FROM evaluations GROUP BY 1)
      SELECT trace_id, model_id, status, coalesce(n, 0) AS n_evaluations, s AS avg_score, coalesce(f, 0) AS n_failed FROM traces LEFT JOIN o USING (trace_id)""",
    "trace_evaluations": f"{_E} SELECT trace_id, evaluator, verdict, score FROM evaluations WHERE trace_id = (SELECT CAST(min(doc_id) AS VARCHAR) FROM labels)",
    "evaluation_page": f'{_E} SELECT trace_id, "timestamp", model_id, verdict, score FROM evaluations ORDER BY "timestamp" DESC, seq DESC LIMIT 50',
    "trace_page_total": f"""{_T} SELECT trace_id, "timestamp", latency_ms, (SELECT count(*) FROM traces WHERE is_error) AS total FROM traces WHERE is_error ORDER BY "timestamp" DESC, trace_id LIMIT 20""",
    "cost_summary": f"""{_T}, m AS (SELECT model_id, sum(cost_micros) AS c FROM traces GROUP BY 1)
      SELECT CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) AS requests, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(sum(cost_micros) / count(*), 6) AS cost_per_request,
        (SELECT model_id FROM m ORDER BY c DESC, model_id DESC LIMIT 1) AS top_model FROM traces""",
    "cost_breakdowns": f"{_W} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {column} AS value, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) AS requests, round(100.0::DOUBLE * sum(cost_micros) / {_TOTAL}, 6) AS percent FROM wide GROUP BY 2"
        for name, column in _COSTS.items()
    ),
    "cost_hourly": f"""{_W} SELECT date_trunc('hour', "timestamp") AS hour, model_id, user_id, feature_id, environment, count(*) AS requests, CAST(sum(cost_micros) AS BIGINT) AS cost_micros,
      CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM wide GROUP BY ALL""",
    "cost_spend_rate": f"""{_T} SELECT model_id, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, round(sum(cost_micros) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3600000000), 6) AS per_hour FROM traces GROUP BY 1""",
    "slices_all": f"{_W} {_SLICES}",
    "slices_against_baseline": f"""{_T}, m AS (SELECT max("timestamp") AS as_of FROM traces),
      r AS (SELECT model_id AS slice, count(*) FILTER ("timestamp" > as_of - INTERVAL 48 HOURS) AS n, avg(CAST(is_error AS DOUBLE)) FILTER ("timestamp" > as_of - INTERVAL 48 HOURS) AS rate, avg(CAST(is_error AS DOUBLE)) AS base
        FROM traces, m WHERE "timestamp" > as_of - INTERVAL 336 HOURS GROUP BY 1)
      SELECT slice, n, round(rate, 8) AS rate, round(base, 8) AS baseline, round((rate - base) / nullif(base, 0), 8) AS deviation FROM r WHERE n >= 5""",
    "hourly_quality": f"""{_E}, c AS (SELECT date_trunc('hour', "timestamp") AS hour, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency FROM traces GROUP BY 1),
      q AS (SELECT date_trunc('hour', "timestamp") AS hour, round(avg(score), 8) AS quality FROM evaluations GROUP BY 1) SELECT hour, error_rate, p95_latency, quality FROM c LEFT JOIN q USING (hour)""",
    "traces_unexpired": f"""{_T} SELECT trace_id, "timestamp" FROM traces WHERE "timestamp" > (SELECT max("timestamp") FROM traces) - INTERVAL 10 DAYS""",
    "system_health": f"""{V.with_views(V.EVALUATIONS_SQL, V.DRIFT_ALERTS_SQL)}, a AS (SELECT model_id, count(*) FILTER (status = 'open') AS alerts, avg(score) AS s FROM drift_alerts GROUP BY 1),
      m AS (SELECT model_id, avg(score) AS health FROM evaluations GROUP BY 1)
      SELECT round(avg(health), 8) AS health, count(*) FILTER (coalesce(s > 40, false)) AS drifted, CAST(sum(coalesce(alerts, 0)) AS BIGINT) AS alerts, count(*) AS models FROM m LEFT JOIN a USING (model_id)""",
    "threshold_comparisons": f"{_O} {_STREAKS}",
    "anomaly_directions": f"""{_O}, {_ANOMALY}, z AS (SELECT key, seq, (x - m) / s AS z FROM a WHERE n >= 50 AND s > 0)
      SELECT key, seq, round(z, 6) AS z, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS way FROM z WHERE abs(z) > 2""",
    "rate_percent": _O
    + """, r AS (SELECT key, seq, x, "timestamp", arg_min(x, seq) OVER w AS x0, min("timestamp") OVER w AS t0 FROM p
        WINDOW w AS (PARTITION BY key ORDER BY "timestamp" RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)),
      v AS (SELECT key, seq, 100 * ((x - x0) / ((epoch_us("timestamp") - epoch_us(t0)) / 1e6)) / nullif(abs(x0), 0) AS rate FROM r WHERE "timestamp" > t0)
      SELECT key, seq, round(rate, 6) AS rate FROM v WHERE abs(rate) > 5""",
    "oscillation_rule": _O
    + """, l AS (SELECT key, seq, list(x) OVER (PARTITION BY key ORDER BY "timestamp", seq ROWS 19 PRECEDING) AS v FROM p),
      t AS (SELECT key, seq, round(len(list_filter(range(3, len(v) + 1), lambda i: (v[i] - v[i - 1]) * (v[i - 1] - v[i - 2]) < 0)) / (len(v) - 2), 8) AS turns FROM l WHERE len(v) >= 10)
      SELECT * FROM t WHERE turns > 0.8""",
    "psi_stored_reference": _DRIFT["psi"],
    "chi_square_test": f"""WITH c AS ({_DRIFT["chi_square"]}),
      z AS (SELECT *, (pow(chi2 / df, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * df))) / sqrt(2.0::DOUBLE / (9 * df)) AS z FROM c),
      t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z), p AS (SELECT chi2, df, CASE WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END AS p FROM t)
      SELECT chi2, df, round(CASE WHEN df <= 0 OR chi2 <= 0 THEN 1 ELSE p END::DOUBLE, 6) AS p_value, p < 0.05 AS drift FROM p""",
    "drift_by_model": f"""{_T}, s AS (SELECT model_id, count(*) FILTER (seq % 2 = 0) AS ref_n, count(*) FILTER (seq % 2 = 1) AS cur_n,
        abs(avg(latency_ms) FILTER (seq % 2 = 1) - avg(latency_ms) FILTER (seq % 2 = 0)) / nullif(stddev_samp(latency_ms) FILTER (seq % 2 = 0), 0) AS shift FROM traces GROUP BY 1)
      SELECT model_id, ref_n, cur_n, round(shift, 8) AS shift, coalesce(shift > 0.01, false) AS drift FROM s""",
    "drift_trend": f"""{_A}, d AS (SELECT drift_type, CAST(floor(epoch(detected_at) / 86400) AS BIGINT) AS slot, count(*) AS n, avg(score) AS s FROM drift_alerts GROUP BY ALL),
      m AS (SELECT *, s - lag(s) OVER (PARTITION BY drift_type ORDER BY slot) AS move FROM d)
      SELECT drift_type, slot, n, round(s, 8) AS score, CASE WHEN move > 0.01 THEN 'up' WHEN move < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM m""",
    "drift_of_model": f"""{_A} SELECT model_id, drift_type, count(*) AS n, count(*) FILTER (status = 'open') AS open, max(detected_at) AS last_at, round(max(score), 6) AS worst FROM drift_alerts WHERE model_id = 'model_1' GROUP BY ALL""",
    "prompt_delimiters": "SELECT * FROM (SELECT doc_id, concat_ws(',', "
    + ", ".join("CASE WHEN regexp_matches(text, '{}') THEN '{}' END".format(pattern.replace("|]]|", r"|\]\]|"), name) for name, pattern in E.DELIMITERS)
    + ") AS delimiters FROM documents) WHERE delimiters <> ''",
    "prompt_lists": f"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
      SELECT doc_id, CASE WHEN t IN ({", ".join(f"'{x}'" for x in _ALLOWED)}) THEN 'allowed' WHEN {" OR ".join(f"contains(t, '{x}')" for x in _BLOCKED)} THEN 'blocked' ELSE 'neither' END AS listed FROM n""",
    "evaluation_fan_in": f"""{V.with_views(V.EVALUATIONS_SQL)}, b AS (SELECT trace_id AS id, 1 - score / 2 AS score, 1 - score / 2 >= 0.7 AS passed FROM evaluations UNION ALL SELECT trace_id, score, verdict <> 'fail' FROM evaluations)
      SELECT id, round(avg(score), 8) AS score, bool_and(passed) AS passed, count(*) AS n FROM b GROUP BY 1""",
    "failure_cluster_report": f"""{V.with_views(V.TRACES_SQL, V.FAILURES_SQL)}, f AS (SELECT *, CAST(regexp_extract(failure_type, '([0-9]+)', 1) AS BIGINT) AS cluster, 'failure of ' || failure_type || ' model ' || replace(model_id, '_', '') AS text FROM failures),
      r AS (SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, text) AS k FROM f GROUP BY cluster, text),
      w AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS k FROM (
        SELECT cluster, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS word FROM f) GROUP BY cluster, word),
      s AS (SELECT cluster, count(*) AS size, count(DISTINCT user_id) AS users, max("timestamp") AS last_at FROM f GROUP BY 1)
      SELECT cluster, size, users, text AS representative, (SELECT string_agg(word, ',' ORDER BY k) FROM w WHERE w.cluster = s.cluster AND k <= 4) AS keywords,
        (SELECT string_agg(word, ' - ' ORDER BY k) FROM w WHERE w.cluster = s.cluster AND k <= 2) || ' (' || size || ' failures)' AS name,
        round(0.4::DOUBLE * least(1.0, size / 50) + 0.3::DOUBLE * exp(-floor((epoch_us((SELECT max("timestamp") FROM f)) - epoch_us(last_at)) / 3600000000) / 24) + 0.3::DOUBLE * least(1.0, users / 20), 8) AS severity
      FROM s JOIN r USING (cluster) WHERE r.k = 1""",
    "failure_cluster_assignment": """SELECT CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS cluster, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(5 / 6::DOUBLE, 8) ELSE 0 END::DOUBLE AS score, count(*) AS n FROM events GROUP BY ALL""",
    "rca_triggers": f"""{_A}, a AS (SELECT model_id, drift_type, max(score) / 100 AS severity, avg(score) AS m FROM drift_alerts GROUP BY ALL),
      w AS (SELECT model_id, drift_type, concat_ws(',', CASE WHEN m > 10 AND severity >= 0.7 THEN 'drift' END, CASE WHEN m >= 50 AND m / 60 >= 0.7 THEN 'safety' END) AS why FROM a) SELECT * FROM w WHERE why <> ''""",
    "critical_tokens": """WITH c AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS text FROM conversations WHERE role = 'user'),
      w AS (SELECT id, text, string_split(text, ' ') AS w FROM c WHERE length(text) > 0), p AS (SELECT *, generate_subscripts(w, 1) AS i FROM w),
      o AS (SELECT id, CAST(i - 1 AS BIGINT) AS position, w[i] AS token, round(levenshtein(text, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) / length(text), 8) AS influence FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY influence DESC, position) AS rank FROM o WHERE influence > 0.1) SELECT * FROM r WHERE rank <= 10""",
}
