"""Root-cause analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import rca as R
from spanloom.operators import rollups
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)
_F = V.with_views(V.TRACES_SQL, V.FAILURES_SQL)
_S = V.with_views(V.SPANS_SQL)


def _series(s, d, minutes=360):
    e = table(s, d, "events").select("event_type", F.col("ts").alias("timestamp"))
    return R.event_series(e, minutes)


_SERIES = """WITH RECURSIVE c AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL),
  x AS (SELECT t.event_type, g.bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) t
    CROSS JOIN (SELECT unnest(range((SELECT min(bucket) FROM c), (SELECT max(bucket) + 1 FROM c))) AS bucket) g
    LEFT JOIN c ON c.event_type = t.event_type AND c.bucket = g.bucket)"""


def overlap(s, d):
    f = V.failures(s, d)
    p = f.groupBy(F.concat_ws("/", "failure_type", "model_id").alias("pattern_id")).agg(
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.array_sort(F.collect_set("user_id")).alias("members")
    )
    return R.pattern_overlap(p)


def clusters(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("seq"), "text")
    return R.greedy_clusters(docs, 0.7, 2)


def influence(s, d):
    turns = table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("text"))
    return R.token_influence(turns.where("length(text) > 0"))


def counterfactual(s, d):
    turns = table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return R.counterfactuals(turns)


def report(s, d):
    slices = rollups.slice_impact(V.traces(s, d), "service_name", 50).select(F.lit("slice").alias("category"), F.col("slice").alias("factor"), F.least(F.abs("deviation"), F.lit(1.0)).alias("severity"))
    groups = R.failure_groups(V.failures(s, d)).select(F.lit("failure").alias("category"), F.col("failure_type").alias("factor"), "severity")
    return R.causal_report(slices.unionByName(groups))


QUERIES = {
    "event_series": lambda s, d: _series(s, d),
    "cross_correlation": lambda s, d: R.cross_correlation(_series(s, d), 8),
    "event_spikes": lambda s, d: R.spikes(_series(s, d), 2.0),
    "trend_slope": lambda s, d: R.trend(_series(s, d)),
    "periodicity": lambda s, d: R.periodicity(_series(s, d), 24, 0.05),
    "failure_groups": lambda s, d: R.failure_groups(V.failures(s, d)),
    "failure_sessions": lambda s, d: R.sessions(V.failures(s, d), 60, 2),
    "pattern_overlap": overlap,
    "span_tree": lambda s, d: R.span_tree(V.spans(s, d)),
    "critical_path": lambda s, d: R.critical_path(V.spans(s, d)),
    "greedy_text_clusters": clusters,
    "token_influence": influence,
    "counterfactuals": counterfactual,
    "causal_report": report,
}

_IMPACT = """base AS (SELECT avg(CAST(is_error AS DOUBLE)) AS base, count(*) AS total FROM traces),
  s AS (SELECT service_name AS slice, count(*) AS n, avg(CAST(is_error AS DOUBLE)) AS rate FROM traces GROUP BY 1 HAVING count(*) >= 50),
  f AS (SELECT 'slice' AS category, slice AS factor, least(abs(round(dev, 8)), 1.0) AS severity FROM (SELECT *, (rate - base) / base AS dev FROM s, base) WHERE abs(dev) >= 0.1
    UNION ALL SELECT 'failure', failure_type, severity FROM g)"""
_GROUPS = """g AS (SELECT failure_type, n, users, round((least(n / 100, 1) + least(users / 50, 1) + least(us / 1e6 / 3600, 1)) / 3, 8) AS severity FROM (
    SELECT failure_type, count(*) AS n, count(DISTINCT user_id) AS users, epoch_us(max("timestamp")) - epoch_us(min("timestamp")) AS us FROM failures GROUP BY 1) WHERE n >= 5)"""
_ROOTS = """k AS (SELECT a.*, p.span_id IS NOT NULL AS known FROM spans a LEFT JOIN spans p ON p.trace_id = a.trace_id AND p.span_id = a.parent_span_id)"""

ORACLE_SQL = {
    "event_series": _SERIES + " SELECT * FROM x",
    "cross_correlation": _SERIES
    + """, r AS (SELECT a.event_type AS left_type, b.event_type AS right_type, lag, round(corr(a.n, b.n), 6) AS r, count(*) AS n FROM x a JOIN range(-8, 9) l(lag) ON true
        JOIN x b ON b.bucket = a.bucket + lag WHERE a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 10),
      t AS (SELECT *, row_number() OVER (PARTITION BY left_type, right_type ORDER BY abs(r) DESC, lag) AS k FROM r WHERE r IS NOT NULL)
      SELECT left_type, right_type, lag, r, n, CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN lag = 0 THEN 'concurrent' WHEN lag > 0 THEN 'left leads' ELSE 'right leads' END AS direction FROM t WHERE k = 1""",
    "event_spikes": _SERIES
    + """, l AS (SELECT *, avg(n) OVER (PARTITION BY event_type) + 2 * stddev_pop(n) OVER (PARTITION BY event_type) AS level FROM x)
      SELECT event_type, min(bucket) AS bucket, arg_min(n, bucket) AS n, round(arg_min(level, bucket), 6) AS level FROM l WHERE n > level GROUP BY 1""",
    "trend_slope": _SERIES
    + """ SELECT event_type, round(regr_slope(n, i), 8) AS slope, round(least(1.0, 10 * abs(round(regr_slope(n, i), 8))), 7) AS confidence
      FROM (SELECT *, bucket - min(bucket) OVER (PARTITION BY event_type) AS i FROM x) GROUP BY 1""",
    "periodicity": _SERIES
    + """, r AS (SELECT a.event_type, lag, round(corr(a.n, b.n), 6) AS r FROM x a JOIN range(1, 25) l(lag) ON true JOIN x b ON b.event_type = a.event_type AND b.bucket = a.bucket + lag GROUP BY ALL),
      t AS (SELECT *, lag(r) OVER (PARTITION BY event_type ORDER BY "lag") AS l, lead(r) OVER (PARTITION BY event_type ORDER BY "lag") AS h FROM r)
      SELECT event_type, min("lag") AS lag, arg_min(r, "lag") AS r FROM t WHERE r > 0.05 AND r > l AND r >= h GROUP BY 1""",
    "failure_groups": f"{_F}, {_GROUPS} SELECT * FROM g",
    "failure_sessions": f"""{_F}, a AS (SELECT *, coalesce("timestamp" - lag("timestamp") OVER w > INTERVAL 60 MINUTES, true) AS new FROM failures WINDOW w AS (PARTITION BY model_id ORDER BY "timestamp", seq)),
      b AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY model_id ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS session FROM a)
      SELECT model_id, session, count(*) AS n, min("timestamp") AS first_at, max("timestamp") AS last_at FROM b GROUP BY ALL HAVING count(*) >= 2""",
    "pattern_overlap": f"""{_F}, p AS (SELECT failure_type || '/' || model_id AS pattern_id, min("timestamp") AS first_at, max("timestamp") AS last_at, list(DISTINCT user_id) AS members FROM failures GROUP BY 1),
      o AS (SELECT l.pattern_id AS l_pattern_id, r.pattern_id AS r_pattern_id, CAST(len(list_intersect(l.members, r.members)) AS BIGINT) AS common,
        round(len(list_intersect(l.members, r.members)) / least(len(l.members), len(r.members)), 8) AS overlap
        FROM p l JOIN p r ON l.pattern_id < r.pattern_id AND l.first_at <= r.last_at AND r.first_at <= l.last_at) SELECT * FROM o WHERE overlap >= 0.5""",
    "span_tree": _S.replace("WITH ", "WITH RECURSIVE ")
    + f""", {_ROOTS}, t AS (SELECT trace_id, span_id, span_id AS root_id, CAST(0 AS BIGINT) AS depth FROM k WHERE NOT known
        UNION ALL SELECT k.trace_id, k.span_id, t.root_id, t.depth + 1 FROM k JOIN t ON k.known AND k.trace_id = t.trace_id AND k.parent_span_id = t.span_id) SELECT * FROM t""",
    "critical_path": _S.replace("WITH ", "WITH RECURSIVE ")
    + f""", {_ROOTS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY duration_ns DESC, span_id) AS n FROM k WHERE known) WHERE n = 1),
      t AS (SELECT trace_id, span_id AS root_id, span_id, duration_ns, CAST(0 AS BIGINT) AS step FROM k WHERE NOT known
        UNION ALL SELECT h.trace_id, t.root_id, h.span_id, h.duration_ns, t.step + 1 FROM h JOIN t ON h.trace_id = t.trace_id AND h.parent_span_id = t.span_id) SELECT * FROM t""",
    "token_influence": """WITH c AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS text FROM conversations WHERE role = 'user'),
      w AS (SELECT id, text, string_split(text, ' ') AS w FROM c WHERE length(text) > 0), p AS (SELECT *, generate_subscripts(w, 1) AS i FROM w)
      SELECT id, CAST(i - 1 AS BIGINT) AS position, w[i] AS token, round(levenshtein(text, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) / length(text), 8) AS influence FROM p""",
    "causal_report": f"""{_F}, {_GROUPS}, {_IMPACT}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY severity DESC, factor) AS k FROM f),
      o AS (SELECT category, count(*) AS n, max(severity) AS severity, string_agg(factor, ', ' ORDER BY k) FILTER (k <= 3) AS top_factors FROM r GROUP BY 1)
      SELECT category, n, round(severity, 8) AS severity, top_factors, round(0.5::DOUBLE + CASE WHEN n >= 3 THEN 0.2 ELSE 0 END + CASE WHEN severity >= 0.5 THEN 0.15 ELSE 0 END + CASE WHEN severity >= 0.8 THEN 0.15 ELSE 0 END, 6) AS confidence FROM o""",
}
