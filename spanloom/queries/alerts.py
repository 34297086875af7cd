"""Alert rules, suppression, grouping, and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import alerts as A
from spanloom.operators import sampling as P
from spanloom.operators import sequential as S
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)
_O = _T + """, p AS (SELECT model_id AS key, "timestamp", seq, latency_ms AS x FROM traces) """


def _points(s, d):
    return V.traces(s, d).select(F.col("model_id").alias("key"), "timestamp", "seq", F.col("latency_ms").alias("x"))


def _events(s, d):
    """Errors and slow calls as alert events."""
    t = V.traces(s, d).where("is_error or latency_ms > 60")
    rank = F.when(F.col("latency_ms") > 100, 4).when(F.col("latency_ms") > 60, 3).otherwise(2)
    mark = A.fingerprint(F.lit("latency"), F.col("service_name"), {"model": F.col("model_id"), "provider": F.col("provider")})
    return t.select(mark.alias("fingerprint"), "timestamp", "seq", "model_id", "service_name", "latency_ms", rank.alias("severity_rank"))


_EVENTS = _T + """, e AS (SELECT md5('latency|' || service_name || '|model=' || model_id || '|provider=' || provider) AS fingerprint, "timestamp", seq, model_id, service_name, latency_ms,
    CASE WHEN latency_ms > 100 THEN 4 WHEN latency_ms > 60 THEN 3 ELSE 2 END AS severity_rank FROM traces WHERE is_error OR latency_ms > 60),
  g AS (SELECT *, "timestamp" - lag("timestamp") OVER (PARTITION BY fingerprint ORDER BY "timestamp", seq) AS gap FROM e),
  d AS (SELECT *, gap IS NULL OR gap >= INTERVAL 60 MINUTES AS is_new FROM g),
  n AS (SELECT *, count(*) FILTER (is_new) OVER (PARTITION BY fingerprint ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS episode FROM d) """


def suppressed(s, d):
    rows = [("2024-01-05 00:00:00", "2024-01-08 00:00:00", {"model": "model_1"}), ("2024-01-10 00:00:00", "2024-01-11 00:00:00", {"service": "error", "unknown": "x"})]
    silences = s.createDataFrame(rows, "start string, stop string, matchers map<string,string>").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
    events = _events(s, d).withColumn("labels", F.create_map(F.lit("model"), "model_id", F.lit("service"), "service_name"))
    return A.suppress(events, silences).select("seq", "fingerprint")


def composite(s, d):
    p = _points(s, d)
    return A.composite({"high": A.threshold(p, 60.0, 1), "odd": A.anomaly(p, 2.5, 50)}, True)


def span_states(s, d):
    e = table(s, d, "events")
    parent = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), "event_id"))
    state = F.when(F.col("event_id") % 3 == 1, F.when(F.col("event_id") % 2 == 0, "sampled=true").otherwise("x=1;sampled=0")).otherwise("")
    return e.select(F.col("event_id").cast("string").alias("trace_id"), parent.alias("parent_span_id"), state.alias("trace_state"))


def cooldown(s, d):
    a = V.drift_alerts(s, d).select(F.col("model_id").alias("key"), F.col("detected_at").alias("timestamp"), F.col("alert_id").alias("seq"))
    return S.cooldown(a, 1800.0)


QUERIES = {
    "threshold_consecutive": lambda s, d: A.threshold(_points(s, d), 25.0, 2),
    "anomaly_zscore": lambda s, d: A.anomaly(_points(s, d), 3.0, 50),
    "rate_rule": lambda s, d: A.rate(_points(s, d), 0.1, 600),
    "pattern_rules": lambda s, d: A.patterns(_points(s, d)),
    "composite_rule": composite,
    "alert_dedup_gap": lambda s, d: A.deduplicate(_events(s, d), 60).select("seq", "fingerprint", "is_new", "episode"),
    "alert_suppression": suppressed,
    "alert_groups": lambda s, d: A.groups(_events(s, d), ["model_id", "service_name"]),
    "alert_auto_resolve": lambda s, d: A.auto_resolve(_events(s, d), 60),
    "alert_notifications": lambda s, d: A.notifications(_events(s, d), "{{service_name}} of {{model_id}} took long (severity {{severity_rank}})", 3),
    "alert_cooldown": cooldown,
    "sample_probabilistic": lambda s, d: P.probabilistic(V.traces(s, d), 0.2).select("trace_id"),
    "sample_parent_based": lambda s, d: P.parent_based(span_states(s, d), 0.3).select("trace_id"),
    "sample_by_service": lambda s, d: P.by_service(V.traces(s, d), {"error": 1.0, "view": 0.1}, 0.5).select("trace_id", "service_name"),
    "token_bucket": lambda s, d: S.token_bucket(_points(s, d), 1 / 1200, 5.0),
}

_SHARE = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)::DOUBLE / 1152921504606846976.0::DOUBLE"
_ANOMALY = """a AS (SELECT key, seq, x, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM p
    WINDOW w AS (PARTITION BY key ORDER BY "timestamp" RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))"""

ORACLE_SQL = {
    "threshold_consecutive": _O
    + """, i AS (SELECT *, count(*) FILTER (x <= 25) OVER (PARTITION BY key ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS island FROM p),
      s AS (SELECT *, count(*) FILTER (x > 25) OVER (PARTITION BY key, island ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS streak FROM i)
      SELECT key, seq, streak FROM s WHERE x > 25 AND streak >= 2""",
    "anomaly_zscore": f"{_O}, {_ANOMALY} SELECT key, seq, round((x - m) / s, 6) AS z FROM a WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 3",
    "rate_rule": _O
    + """, r AS (SELECT key, seq, x, "timestamp", arg_min(x, seq) OVER w AS x0, min("timestamp") OVER w AS t0 FROM p
        WINDOW w AS (PARTITION BY key ORDER BY "timestamp" RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW))
      SELECT key, seq, round((x - x0) / ((epoch_us("timestamp") - epoch_us(t0)) / 1e6), 6) AS rate FROM r
      WHERE "timestamp" > t0 AND abs((x - x0) / ((epoch_us("timestamp") - epoch_us(t0)) / 1e6)) > 0.1""",
    "pattern_rules": _O
    + """, l AS (SELECT key, seq, list(x) OVER (PARTITION BY key ORDER BY "timestamp", seq ROWS 19 PRECEDING) AS v FROM p),
      b AS (SELECT *, len(v) AS n, v[1:len(v) - 1] AS before, len(v) // 2 AS half FROM l WHERE len(v) >= 10),
      m AS (SELECT *, list_avg(before) AS m, list_stddev_pop(before) AS sd, list_avg(v[1:half]) AS m1, list_avg(v[half + 1:]) AS m2,
        len(list_filter(range(2, n + 1), lambda i: v[i] > v[i - 1])) AS ups FROM b),
      s AS (SELECT key, seq, CASE WHEN sd > 0 AND v[n] > m + 3 * sd THEN 'spike' WHEN sd > 0 AND v[n] < m - 3 * sd THEN 'dip' WHEN sd > 0 AND abs(m2 - m1) > 2 * sd THEN 'step'
        WHEN ups >= 0.8 * (n - 1) THEN 'rise' WHEN ups <= 0.2 * (n - 1) THEN 'fall' END AS pattern FROM m)
      SELECT * FROM s WHERE pattern IS NOT NULL""",
    "composite_rule": f"{_O}, {_ANOMALY} SELECT key, seq, 'high,odd' AS rules FROM a WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 2.5 AND x > 60",
    "alert_dedup_gap": _EVENTS + "SELECT seq, fingerprint, is_new, episode FROM n",
    "alert_suppression": _EVENTS
    + """SELECT seq, fingerprint FROM e WHERE NOT ("timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-08' AND model_id = 'model_1')
      AND NOT ("timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-11' AND service_name = 'error')""",
    "alert_groups": _EVENTS
    + """SELECT model_id, service_name, count(*) AS n, CAST(max(severity_rank) AS INTEGER) AS severity_rank, min("timestamp") AS first_at, max("timestamp") AS last_at FROM e GROUP BY ALL""",
    "alert_auto_resolve": _EVENTS
    + """SELECT fingerprint, episode, max("timestamp") AS last_at, count(*) AS n, max("timestamp") + INTERVAL 60 MINUTES AS resolved_at FROM n GROUP BY ALL""",
    "alert_notifications": _EVENTS + "SELECT seq, service_name || ' of ' || model_id || ' took long (severity ' || severity_rank || ')' AS payload FROM e WHERE severity_rank >= 3",
    "sample_probabilistic": f"{_T} SELECT trace_id FROM traces WHERE {_SHARE.format('trace_id')} < 0.2",
    "sample_parent_based": f"""WITH e AS (SELECT event_id, CAST(event_id AS VARCHAR) AS trace_id FROM events)
      SELECT trace_id FROM e WHERE CASE WHEN event_id % 3 = 1 THEN event_id % 2 = 0 ELSE {_SHARE.format("trace_id")} < 0.3 END""",
    "sample_by_service": f"""{_T} SELECT trace_id, service_name FROM traces WHERE {_SHARE.format("trace_id")} < CASE service_name WHEN 'error' THEN 1.0 WHEN 'view' THEN 0.1 ELSE 0.5 END""",
}
