"""Telemetry messages, streams, and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.plans import guard
from spanloom.session import Workspace
from spanloom.sources import otlp
from spanloom.sources import views as V
from spanloom.sources.tables import table
from spanloom.operators import detectors
from spanloom.queries import drift
from spanloom.streaming import jobs, stateful

_T = V.with_views(V.TRACES_SQL)


def _messages(s, d):
    """Events as nested exports, three spans a message in one of two spellings."""
    e = table(s, d, "events").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    attributes = F.array(F.struct(F.lit("user").alias("key"), F.struct(F.col("user_id").cast("string").alias("intValue")).alias("value")))
    camel = F.struct(
        F.col("event_id").cast("string").alias("traceId"), F.lit("1").alias("spanId"), F.col("event_type").alias("name"), F.col("ns").cast("string").alias("startTimeUnixNano"),
        (F.col("ns") + 5000).cast("string").alias("endTimeUnixNano"), F.struct(F.when(F.col("event_type") == "error", "2").otherwise("STATUS_CODE_OK").alias("code")).alias("status"), attributes.alias("attributes"),
    )
    service = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.concat(F.lit("svc"), F.col("event_id") % 4).alias("stringValue")).alias("value")))
    scope = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(camel).alias("spans"))
    resource = F.struct(F.struct(service.alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))
    good = e.select(F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("value"))
    return good.union(e.limit(3).select(F.lit("{not json").alias("value")))


def otlp_flatten(s, d):
    rows = otlp.flatten(_messages(s, d))
    user = F.try_element_at("attributes", F.lit("user"))
    return rows.select("trace_id", "service_name", "span_name", "status", "duration_ns", user.alias("user_id"), F.expr("start_ns div 1000").alias("start_us"))


def stream_rollup(s, d):
    spans = jobs.event_spans(jobs.file_stream(s, d, "events"))
    out = jobs.to_table(jobs.rollup(spans), "complete", Workspace(s, "rollup").root)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "model_id", "n", F.round("latency_sum", 4).alias("latency_sum"), "errors")


def stream_distinct(s, d):
    events = jobs.file_stream(s, d, "events")
    twice = jobs.event_spans(events).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.to_table(jobs.distinct_spans(twice), "append", Workspace(s, "distinct").root).select("trace_id", "service_name")


def stream_limited(s, d):
    return jobs.to_table(jobs.rate_limited(jobs.event_spans(jobs.file_stream(s, d, "events")), 1 / 3600, 10.0), "append", Workspace(s, "limited").root)


def guarded(s, d):
    sql = """SELECT model_id, uniqExact(user_id) AS users, round(quantile(0.5)(latency_ms), 6) AS p50, countIf(is_error) AS errors FROM traces
      WHERE timestamp >= :since AND model_id IN (SELECT model_id FROM traces WHERE status = 'error') GROUP BY model_id"""
    return guard.run(s, {"traces": V.traces(s, d)}, sql, since="2024-01-10")


def guarded_nested(s, d):
    sql = """SELECT multiIf(p > 400, 'slow', p > 100, 'fair', 'fast') AS speed, uniqExact(concat_model) AS models, sum(n) AS n FROM (
        SELECT upper(model_id) AS concat_model, toDayOfWeek(toStartOfHour(timestamp)) AS day, quantile(0.5)(abs(round(latency_ms, 3))) AS p, count(*) AS n
        FROM traces WHERE length(toString(abs(toInt64(input_tokens)))) BETWEEN 1 AND 9 GROUP BY upper(model_id), toDayOfWeek(toStartOfHour(timestamp))
    ) GROUP BY 1"""
    return guard.run(s, {"traces": V.traces(s, d)}, sql)


def _hard_messages(s, d):
    """Exports whose texts hold quotes, backslashes and brackets; every fiftieth is nested too deep, every seventieth is cut short."""
    e = table(s, d, "events")
    said = F.concat("event_type", F.lit(' said: "["\\" '), F.repeat(F.lit("[{"), 30))
    attributes = F.array(F.struct(F.lit("said").alias("key"), F.struct(said.alias("stringValue")).alias("value")))
    span = F.struct(F.col("event_id").cast("string").alias("traceId"), F.lit("1").alias("spanId"), F.col("event_type").alias("name"), attributes.alias("attributes"))
    text = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    deep = F.concat(F.lit('{"resourceSpans": '), F.repeat(F.lit("["), 40), F.repeat(F.lit("]"), 40), F.lit("}"))
    value = F.when(F.col("event_id") % 50 == 0, deep).when(F.col("event_id") % 70 == 1, F.expr("substring(text, 1, length(text) - 3)")).otherwise(F.col("text"))
    return e.select("event_id", text.alias("text")).select(value.alias("value"))


def otlp_strings(s, d):
    rows = otlp.flatten(_hard_messages(s, d))
    return rows.select("trace_id", "span_name", F.try_element_at("attributes", F.lit("said")).alias("said"))


def otlp_refused(s, d):
    return otlp.refused(_hard_messages(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


def detectors_resumed(s, d):
    """Outcomes day by day in three parts, each of which begins with the states that the last one saved."""
    rows, work, states, out = drift._outcomes(s, d), Workspace(s, "detectors"), None, None
    for low, high in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-20"), ("2024-01-20", "2025-01-01")):
        part = rows.where((F.col("timestamp") >= F.lit(low).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(high).cast("timestamp_ntz")))
        some, states = detectors.advance(work, part, "ddm", states)
        out = some if out is None else out.union(some)
    return out.withColumn("value", F.round("value", 8))


def page_hinkley_resets(s, d):
    return detectors.advance(Workspace(s, "ph"), drift._outcomes(s, d), "page_hinkley", threshold=10.0)[0]


def stream_sliding(s, d):
    spans = jobs.event_spans(jobs.file_stream(s, d, "events"))
    out = jobs.to_table(jobs.sliding(spans, "6 hours", "2 hours"), "complete", Workspace(s, "sliding").root)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "model_id", "n", "errors")


def stream_episodes(s, d):
    """Errors by model as alerts; those of the last minutes are still open."""
    spans = jobs.event_spans(jobs.file_stream(s, d, "events")).where("is_error").select(F.col("model_id").alias("fingerprint"), "timestamp")
    out = jobs.to_table(jobs.alert_episodes(spans, 15, 24), "append", Workspace(s, "episodes").root)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("opened_at", "last_at", "resolved_at", "expires_at")}
    return out.withColumns(times).select("fingerprint", *times, "n")


def stream_batches(s, d):
    spans = jobs.event_spans(jobs.file_stream(s, d, "events"))
    out = jobs.to_table(stateful.batches(spans, 100, 10_000, 60.0), "append", Workspace(s, "batches").root)
    return out.groupBy("model_id", "batch", "closed_by").agg(F.count("*").alias("n"))


QUERIES = {
    "otlp_flatten": otlp_flatten,
    "stream_rollup": stream_rollup,
    "stream_distinct": stream_distinct,
    "stream_rate_limited": stream_limited,
    "guarded_sql": guarded,
    "guarded_sql_nested": guarded_nested,
    "otlp_strings": otlp_strings,
    "otlp_refused": otlp_refused,
    "detectors_resumed": detectors_resumed,
    "page_hinkley_resets": page_hinkley_resets,
    "stream_sliding": stream_sliding,
    "stream_episodes": stream_episodes,
    "stream_batches": stream_batches,
}

ORACLE_SQL = {
    "otlp_flatten": """SELECT CAST(event_id AS VARCHAR) AS trace_id, 'svc' || CAST(event_id % 4 AS VARCHAR) AS service_name, event_type AS span_name,
      CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(5000 AS BIGINT) AS duration_ns, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS start_us FROM events""",
    "stream_rollup": f"""{_T} SELECT date_trunc('hour', "timestamp") AS hour, model_id, count(*) AS n, round(sum(latency_ms), 4) AS latency_sum, count(*) FILTER (is_error) AS errors
      FROM traces GROUP BY ALL""",
    "stream_distinct": f"{_T} SELECT trace_id, service_name FROM traces",
    "guarded_sql": f"""{_T} SELECT model_id, count(DISTINCT user_id) AS users, round(quantile_cont(latency_ms, 0.5), 6) AS p50, count(*) FILTER (is_error) AS errors FROM traces
      WHERE "timestamp" >= TIMESTAMP '2024-01-10' AND model_id IN (SELECT model_id FROM traces WHERE status = 'error') GROUP BY 1""",
    "guarded_sql_nested": f"""{_T}, p AS (SELECT upper(model_id) AS m, isodow(date_trunc('hour', "timestamp")) AS day, quantile_cont(abs(round(latency_ms, 3)), 0.5) AS p, count(*) AS n FROM traces
        WHERE length(CAST(abs(input_tokens) AS VARCHAR)) BETWEEN 1 AND 9 GROUP BY 1, 2)
      SELECT CASE WHEN p > 400 THEN 'slow' WHEN p > 100 THEN 'fair' ELSE 'fast' END AS speed, count(DISTINCT m) AS models, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""",
    "otlp_strings": """SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS span_name, event_type || ' said: "["\\" ' || repeat('[{', 30) AS said FROM events
      WHERE event_id % 50 <> 0 AND event_id % 70 <> 1""",
    "otlp_refused": """SELECT CASE WHEN event_id % 50 = 0 THEN 'too deep' ELSE 'no JSON' END AS reason, count(*) AS n FROM events WHERE event_id % 50 = 0 OR event_id % 70 = 1 GROUP BY 1""",
    "detectors_resumed": f"""SELECT key, seq, n, state, p AS value FROM ({drift.ORACLE_SQL['ddm']}) WHERE state <> 'stable'""",
    "stream_sliding": f"""{_T} SELECT date_trunc('hour', "timestamp") - to_hours(hour("timestamp") % 2 + 2 * k) AS start, model_id, count(*) AS n, count(*) FILTER (is_error) AS errors
      FROM traces, range(3) r(k) GROUP BY ALL""",
    "stream_episodes": f"""{_T}, e AS (SELECT model_id AS fingerprint, "timestamp" AS t FROM traces WHERE is_error),
      g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY fingerprint ORDER BY t) >= INTERVAL 15 MINUTE, true) AS new FROM e),
      n AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY fingerprint ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT fingerprint, min(t) AS opened_at, max(t) AS last_at, max(t) + INTERVAL 15 MINUTE AS resolved_at, max(t) + INTERVAL 24 HOUR AS expires_at, count(*) AS n FROM n
      GROUP BY fingerprint, k HAVING max(t) + INTERVAL 15 MINUTE <= (SELECT max(t) - INTERVAL 10 MINUTE FROM e)""",
}
