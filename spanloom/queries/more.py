"""Reference windows, outcome streams, comparisons and other small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import alerts as A
from spanloom.operators import cost as C
from spanloom.operators import drift as D
from spanloom.operators import rca as R
from spanloom.operators import rollups
from spanloom.operators import sequential as S
from spanloom.queries.drift import _LONG, _long
from spanloom.queries.rca import _SERIES, _series
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)


def _pairs(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    even = v.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("id"), F.col("v").alias("a"))
    odd = v.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("id"), F.col("v").alias("b"))
    return even.join(odd, "id").select("id", F.round(D.embedding_error(F.col("a"), F.col("b")), 6).alias("error"))


def _outcomes(s, d):
    e = table(s, d, "events")
    attributes = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("correct"), F.when(F.col("event_type") == "error", "no").otherwise("TRUE")))
    attributes = attributes.when(F.col("event_id") % 3 == 1, F.create_map(F.lit("error"), (F.col("event_type") == "error").cast("int").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select("event_type", D.correct(attributes).alias("correct")).groupBy("event_type", "correct").agg(F.count("*").alias("n"))


def cost_estimate(s, d):
    """Input tokens from characters, 500 tokens of output, at one model's price."""
    price = next(p for p in V.PRICES if p[0] == "gpt-4o")
    rows = table(s, d, "documents").select("doc_id", F.expr("char_length(text) div 4").alias("input_tokens"), F.lit(price[2]).cast("long").alias("pi"), F.lit(price[3]).cast("long").alias("po"), F.lit(500).cast("long").alias("output_tokens"))
    return rows.select("doc_id", (C.cost_micros("input_tokens", "pi") + C.cost_micros("output_tokens", "po")).alias("cost_micros"))


def for_duration(s, d):
    """Runs of slow calls of a model that last at least two hours."""
    p = V.traces(s, d).select(F.col("model_id").alias("key"), "timestamp", "seq", F.col("latency_ms").alias("x"))
    rows = S.streak(p, F.col("x") > 12.0).where("streak > 0")
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("timestamp", "seq")
    rows = rows.withColumn("run", F.count_if(F.col("streak") == 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("key", "run").agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("us"))
    return out.where(F.col("us") >= 7_200_000_000).select("key", "first_at", "last_at", "n")


def metrics_unpivot(s, d):
    rows = V.traces(s, d).groupBy("model_id").agg(
        F.count("*").cast("double").alias("requests"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(F.avg(F.col("is_error").cast("double")), 8).alias("error_rate")
    )
    return rows.unpivot("model_id", ["requests", "latency", "error_rate"], "metric", "metric_value")


def annotations(s, d):
    rows = V.drift_alerts(s, d).where("detected_at >= TIMESTAMP_NTZ'2024-01-10 00:00:00' and detected_at < TIMESTAMP_NTZ'2024-01-12 00:00:00'")
    return rows.select("alert_id", "detected_at", F.concat_ws(" ", "severity", "drift_type", "model_id").alias("title"))


def problem_slices(s, d):
    """The worst slices over several dimensions together."""
    t = V.traces(s, d)
    parts = [rollups.slice_impact(t, dim, 50).select(F.lit(dim).alias("dimension"), F.col("slice").cast("string"), "n", "impact") for dim in ("model_id", "service_name", "provider")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("impact"), "dimension", "slice").limit(10)


def token_diff(s, d):
    t = table(s, d, "conversations")
    a = t.where("role = 'user'").select(F.col("conv_id"), "turn", F.col("text").alias("left_text"))
    b = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_text"))
    return R.token_diff(a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "left_text", "right_text"))


def alert_states(s, d):
    """Latest status of each alert from a log of status events."""
    a = V.drift_alerts(s, d)
    log = a.select("alert_id", F.lit("open").alias("state"), F.col("detected_at").alias("at"))
    log = log.union(a.where("status = 'resolved'").select("alert_id", F.lit("resolved"), F.expr("detected_at + INTERVAL 1 HOUR")))
    return C.latest(log, ["alert_id"], "at").groupBy("state").agg(F.count("*").alias("n"))


def grouped_alerts(s, d):
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in (("low", 1), ("medium", 2), ("high", 3), ("critical", 4)) for x in kv)), F.col("severity"))
    rows = V.drift_alerts(s, d).select("model_id", "drift_type", rank.alias("severity_rank"), F.col("detected_at").alias("timestamp"))
    return A.groups(rows, ["model_id", "drift_type"])


QUERIES = {
    "reference_window": lambda s, d: D.newest(table(s, d, "embeddings"), "label", "vec_id", 20).select("label", "vec_id"),
    "argmax_classes": lambda s, d: table(s, d, "embeddings").select(D.argmax_class(F.col("embedding")).alias("predicted")).groupBy("predicted").agg(F.count("*").alias("n")),
    "embedding_delta_error": _pairs,
    "correctness_extraction": _outcomes,
    "histogram_compare": lambda s, d: D.compare_histograms(_long(s, d)),
    "cost_estimate": cost_estimate,
    "for_duration_rule": for_duration,
    "metrics_unpivot": metrics_unpivot,
    "alert_annotations": annotations,
    "alert_states": alert_states,
    "drift_alert_groups": grouped_alerts,
    "problem_slices": problem_slices,
    "anomaly_points": lambda s, d: R.anomaly_points(_series(s, d), 0.8).select("event_type", "bucket", "n", "level"),
    "preceding_events": lambda s, d: R.preceding(_series(s, d), "error", 8, 0.05),
    "token_diff": token_diff,
    "span_timeline": lambda s, d: R.span_timeline(V.spans(s, d)),
}

_IMPACT = """SELECT '{0}' AS dimension, slice, n, round(abs(dev) * ln(n + 1), 8) AS impact FROM (SELECT *, (rate - base) / nullif(base, 0) AS dev FROM (
    SELECT {0} AS slice, count(*) AS n, avg(CAST(is_error AS DOUBLE)) AS rate FROM traces GROUP BY 1 HAVING count(*) >= 50), base) WHERE abs(dev) >= 0.1"""

ORACLE_SQL = {
    "reference_window": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings) WHERE k <= 20",
    "argmax_classes": "SELECT CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted, count(*) AS n FROM embeddings GROUP BY 1",
    "embedding_delta_error": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
      SELECT a.vec_id // 2 AS id, round((1 - list_cosine_similarity(a.v, b.v)) / 2, 6) AS error FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
    "correctness_extraction": "SELECT event_type, event_id % 3 = 2 OR event_type <> 'error' AS correct, count(*) AS n FROM events GROUP BY ALL",
    "histogram_compare": _LONG
    + """, e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM rows_ GROUP BY 1),
      c AS (SELECT feature, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 20)), 19) END AS bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c
        FROM rows_ JOIN e USING (feature) GROUP BY ALL),
      d AS (SELECT feature, abs(r / sum(r) OVER (PARTITION BY feature) - c / sum(c) OVER (PARTITION BY feature)) AS d FROM c)
      SELECT feature, round(max(d), 8) AS max_diff, round(avg(d), 8) AS mean_diff, count(*) FILTER (d > 0.05) AS bins_apart FROM d GROUP BY 1""",
    "cost_estimate": "SELECT doc_id, CAST(CAST(length(text) // 4 AS BIGINT) * 2500000 // 1000000 + 500 * 10 AS BIGINT) AS cost_micros FROM documents",
    "for_duration_rule": _T
    + """, p AS (SELECT model_id AS key, "timestamp", seq, latency_ms > 12 AS bad FROM traces),
      i AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY key ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS island FROM p)
      SELECT key, min("timestamp") AS first_at, max("timestamp") AS last_at, count(*) AS n FROM i WHERE bad GROUP BY key, island HAVING max("timestamp") - min("timestamp") >= INTERVAL 2 HOURS""",
    "metrics_unpivot": _T
    + """, m AS (SELECT model_id, count(*)::DOUBLE AS requests, round(avg(latency_ms), 6) AS latency, round(avg(CAST(is_error AS DOUBLE)), 8) AS error_rate FROM traces GROUP BY 1)
      SELECT model_id, 'requests' AS metric, requests AS metric_value FROM m UNION ALL SELECT model_id, 'latency', latency FROM m UNION ALL SELECT model_id, 'error_rate', error_rate FROM m""",
    "alert_annotations": f"""{V.with_views(V.DRIFT_ALERTS_SQL)} SELECT alert_id, detected_at, severity || ' ' || drift_type || ' ' || model_id AS title FROM drift_alerts
      WHERE detected_at >= TIMESTAMP '2024-01-10' AND detected_at < TIMESTAMP '2024-01-12'""",
    "alert_states": f"{V.with_views(V.DRIFT_ALERTS_SQL)} SELECT status AS state, count(*) AS n FROM drift_alerts GROUP BY 1",
    "drift_alert_groups": f"""{V.with_views(V.DRIFT_ALERTS_SQL)} SELECT model_id, drift_type, count(*) AS n,
      CAST(max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS INTEGER) AS severity_rank, min(detected_at) AS first_at, max(detected_at) AS last_at FROM drift_alerts GROUP BY ALL""",
    "problem_slices": f"""{_T}, base AS (SELECT avg(CAST(is_error AS DOUBLE)) AS base FROM traces)
      SELECT * FROM ({" UNION ALL ".join(_IMPACT.format(x) for x in ("model_id", "service_name", "provider"))}) ORDER BY impact DESC, dimension, slice LIMIT 10""",
    "anomaly_points": _SERIES
    + """, l AS (SELECT *, round(avg(n) OVER (PARTITION BY event_type) + 2.4 * stddev_pop(n) OVER (PARTITION BY event_type), 6) AS level FROM x) SELECT event_type, bucket, n, level FROM l WHERE n > level""",
    "preceding_events": _SERIES
    + """, r AS (SELECT a.event_type, k, round(corr(a.n, b.n), 6) AS r FROM x a JOIN range(1, 9) l(k) ON true JOIN x b ON b.event_type = 'error' AND b.bucket = a.bucket + k
        WHERE a.event_type <> 'error' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(r) DESC, k) AS i FROM r WHERE abs(r) >= 0.05)
      SELECT event_type, k AS lag, r FROM t WHERE i = 1""",
    "token_diff": """WITH c AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS l, b.text AS r FROM conversations a
        JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
      l AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(string_split(l, ' ')) AS token FROM c) WHERE token <> '' GROUP BY ALL),
      r AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(string_split(r, ' ')) AS token FROM c) WHERE token <> '' GROUP BY ALL)
      SELECT * FROM (SELECT coalesce(l.id, r.id) AS id, coalesce(l.token, r.token) AS token, greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0) AS removed,
        greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0) AS added FROM l FULL JOIN r ON l.id = r.id AND l.token = r.token) WHERE removed > 0 OR added > 0""",
    "span_timeline": f"""{V.with_views(V.SPANS_SQL).replace("WITH ", "WITH RECURSIVE ")}, f AS (SELECT trace_id, min(start_ns) AS first, max(start_ns + duration_ns) AS last FROM spans GROUP BY 1),
      k AS (SELECT a.*, p.span_id IS NOT NULL AS known FROM spans a LEFT JOIN spans p ON p.trace_id = a.trace_id AND p.span_id = a.parent_span_id),
      t AS (SELECT trace_id, span_id, CAST(0 AS BIGINT) AS depth FROM k WHERE NOT known UNION ALL
        SELECT k.trace_id, k.span_id, t.depth + 1 FROM k JOIN t ON k.known AND k.trace_id = t.trace_id AND k.parent_span_id = t.span_id)
      SELECT trace_id, span_id, start_ns - first AS offset_ns, round(duration_ns / (last - first), 8) AS share, depth FROM spans JOIN f USING (trace_id) LEFT JOIN t USING (trace_id, span_id)""",
}
