"""Distances between distributions, and detectors over streams of outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import drift as D
from spanloom.operators import sequential as S
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)
_A = V.with_views(V.DRIFT_ALERTS_SQL)
_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CUT = "TIMESTAMP_NTZ'1998-01-01 00:00:00'"


def _long(s, d):
    """(side, feature, v): numeric columns before and from 1998 on; later prices are moved a little."""
    lines = table(s, d, "lineitem").withColumn("side", F.expr(f"if(l_shipdate < {_CUT}, 'ref', 'cur')"))
    lines = lines.withColumn("l_extendedprice", F.when(F.col("side") == "cur", F.col("l_extendedprice") * 1.25).otherwise(F.col("l_extendedprice")))
    return lines.select("side", *_FEATURES).unpivot("side", list(_FEATURES), "feature", "v")


_LONG = """WITH lines AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side FROM lineitem),
  rows_ AS (SELECT side, 'l_quantity' AS feature, l_quantity AS v FROM lines
    UNION ALL SELECT side, 'l_extendedprice', CASE WHEN side = 'cur' THEN l_extendedprice * 1.25 ELSE l_extendedprice END FROM lines
    UNION ALL SELECT side, 'l_discount', l_discount FROM lines UNION ALL SELECT side, 'l_tax', l_tax FROM lines)"""


def _classes(s, d):
    side = F.when(F.col("l_shipdate") < F.expr(_CUT), "ref").otherwise("cur")
    mode = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))
    # The reference lacks one class.
    return table(s, d, "lineitem").select(side.alias("side"), mode.alias("class")).where("side = 'cur' or class <> 'RF2'")


_CLASSES = """WITH c AS (SELECT class, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM (
    SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side, l_returnflag || l_linestatus || CAST(l_linenumber % 3 AS VARCHAR) AS class
    FROM lineitem) WHERE side = 'cur' OR class <> 'RF2' GROUP BY 1),
  s AS (SELECT class, r, c, r / (SELECT sum(r) FROM c) AS p, c / (SELECT sum(c) FROM c) AS q, (SELECT sum(c) FROM c) AS tc FROM c)"""


def _vectors(s, d):
    return table(s, d, "embeddings").withColumn("side", F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("cur"))


def _centroids(unit: bool) -> str:
    x = "x / sqrt(sum(x * x) OVER (PARTITION BY vec_id))" if unit else "x"
    return f"""WITH x AS (SELECT vec_id, vec_id % 2 AS side, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      m AS (SELECT side, i, avg(x) AS x FROM (SELECT side, i, {x} AS x FROM x) GROUP BY ALL),
      d AS (SELECT sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb FROM m a JOIN m b USING (i) WHERE a.side = 0 AND b.side = 1)"""


def _outcomes(s, d):
    """An error stream of each model; the rate doubles in the second half."""
    e = table(s, d, "events")
    error = ((F.col("event_type") == "error") | ((F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-18 00:00:00'")) & (F.col("event_id") % 4 == 0))).cast("int")
    return e.select(F.concat(F.lit("model_"), F.col("user_id") % 5).alias("key"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), error.alias("error"), (error * 1.0).alias("x"))


_OUTCOMES = """WITH o AS (SELECT 'model_' || CAST(user_id % 5 AS VARCHAR) AS key, ts, event_id AS seq,
    CASE WHEN event_type = 'error' OR (ts >= TIMESTAMP '2024-01-18' AND event_id % 4 = 0) THEN 1 ELSE 0 END AS error FROM events)"""


def _daily(s, d):
    a = V.drift_alerts(s, d)
    return a.groupBy(F.date_trunc("day", "detected_at").alias("day"), "drift_type").agg(F.avg("score").alias("score"))


def multi_dimensional(s, d):
    scores = V.drift_alerts(s, d).groupBy("model_id", "drift_type").agg((F.avg("score") / 100).alias("score"), F.bool_or(F.col("severity") == "critical").alias("drift"))
    return D.multi_dimensional(scores)


def mmd(s, d):
    rows = table(s, d, "embeddings").select(
        F.concat(F.lit("label_"), F.col("label") % 4).alias("key"), F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("cur").alias("side"), F.col("vec_id").alias("id"), "embedding"
    )
    return D.mmd(rows)


QUERIES = {
    "psi": lambda s, d: D.psi(_long(s, d)),
    "ks_test": lambda s, d: D.ks(_long(s, d)),
    "welch_t": lambda s, d: D.welch(_long(s, d)),
    "feature_reference_stats": lambda s, d: D.feature_stats(_long(s, d)),
    "histogram_equal_width": lambda s, d: D.equal_width(_long(s, d)),
    "js_divergence": lambda s, d: D.jensen_shannon(_classes(s, d)),
    "top_changed_classes": lambda s, d: D.top_changed(_classes(s, d)),
    "chi_square": lambda s, d: D.chi_square(_classes(s, d)),
    "text_length_drift": lambda s, d: D.text_length_drift(table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "ref").otherwise("cur").alias("side"), "text")),
    "centroid_drift": lambda s, d: D.centroid_drift(_vectors(s, d)),
    "embedding_mean_cosine": lambda s, d: D.mean_cosine_drift(_vectors(s, d)),
    "mmd_permutation": mmd,
    "drift_multi_dimensional": multi_dimensional,
    "drift_correlation": lambda s, d: D.correlations(_daily(s, d), 3, 0.1),
    "ddm": lambda s, d: S.ddm(_outcomes(s, d)),
    "eddm": lambda s, d: S.eddm(_outcomes(s, d)),
    "page_hinkley": lambda s, d: S.page_hinkley(_outcomes(s, d), 0.005, 5.0),
    "adwin": lambda s, d: S.adwin(_outcomes(s, d)),
}

ORACLE_SQL = {
    "psi": _LONG
    + """, ref AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY feature) AS n FROM rows_ WHERE side = 'ref'),
      e AS (SELECT feature, v AS edge FROM ref JOIN range(1, 10) r(i) ON place = floor(i / 10 * (n - 1))),
      b AS (SELECT side, feature, (SELECT count(*) FROM e WHERE e.feature = x.feature AND e.edge <= x.v) AS bin FROM rows_ x),
      c AS (SELECT feature, bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM b GROUP BY ALL),
      s AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-10) AS e, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-10) AS a FROM c),
      t AS (SELECT feature, sum((a - e) * ln(a / e)) AS s FROM s GROUP BY 1)
      SELECT feature, round(s, 8) AS psi, s >= 0.2 AS drift, CASE WHEN s < 0.1 THEN 'none' WHEN s < 0.25 THEN 'moderate' ELSE 'significant' END AS label FROM t""",
    "ks_test": _LONG
    + """, g AS (SELECT feature, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM rows_ GROUP BY ALL),
      u AS (SELECT feature, sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m
        FROM g WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT feature, max(abs(fr / n - fc / m)) AS d, sqrt(any_value(n) * any_value(m) / (any_value(n) + any_value(m))) AS root FROM u GROUP BY 1)
      SELECT feature, round(d, 8) AS ks, round(least(2 * exp(-2 * pow((root + 0.12 + 0.11 / root) * d, 2)), 1), 8) AS p_value, d > 0.1 AS drift,
        least(2 * exp(-2 * pow((root + 0.12 + 0.11 / root) * d, 2)), 1) < 0.05 AS significant FROM k""",
    "welch_t": _LONG
    + """, s AS (SELECT feature, avg(v) FILTER (side = 'ref') AS a, avg(v) FILTER (side = 'cur') AS b,
        sqrt(var_samp(v) FILTER (side = 'ref') / count(v) FILTER (side = 'ref') + var_samp(v) FILTER (side = 'cur') / count(v) FILTER (side = 'cur')) AS se FROM rows_ GROUP BY 1)
      SELECT feature, round(CASE WHEN se < 1e-10 THEN 0 ELSE abs(a - b) / se END, 6) AS t FROM s""",
    "feature_reference_stats": _LONG
    + " SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high, count(v) AS n FROM rows_ WHERE side = 'ref' GROUP BY 1",
    "histogram_equal_width": _LONG
    + """, e AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) AS n FROM rows_ GROUP BY 1)
      SELECT feature, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 20)), 19) END AS BIGINT) AS bin, round(count(*) / any_value(n), 8) AS share
      FROM rows_ JOIN e USING (feature) GROUP BY ALL""",
    "js_divergence": _CLASSES
    + """ SELECT round((sum(CASE WHEN p > 0 THEN p * ln((p + 1e-10) / ((p + q) / 2 + 1e-10)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln((q + 1e-10) / ((p + q) / 2 + 1e-10)) ELSE 0 END)) / 2, 8) AS js,
      count(*) FILTER (r = 0 AND c > 0) AS new_classes FROM s""",
    "top_changed_classes": _CLASSES + " SELECT class, round(p, 8) AS p, round(q, 8) AS q, round(abs(q - p), 8) AS change FROM s ORDER BY change DESC, class LIMIT 5",
    "chi_square": _CLASSES + " SELECT round(sum(pow(c - p * tc, 2) / (p * tc)), 6) AS chi2, count(*) - 1 AS df FROM s WHERE p * tc > 5",
    "text_length_drift": """SELECT round(score, 8) AS score, score > 0.1 AS drift FROM (SELECT abs(b - a) / CASE WHEN sd > 0 THEN sd ELSE a + 1 END AS score FROM (
      SELECT avg(strlen(text)) FILTER (doc_id % 2 = 0) AS a, avg(strlen(text)) FILTER (doc_id % 2 = 1) AS b, stddev_pop(strlen(text)) FILTER (doc_id % 2 = 0) AS sd FROM documents))""",
    "centroid_drift": _centroids(False) + " SELECT round(1 - ab / (sqrt(aa) * sqrt(bb)), 6) AS score FROM d",
    "embedding_mean_cosine": _centroids(True) + " SELECT round(least(greatest(1 - ab, 0), 1), 6) AS score, least(greatest(1 - ab, 0), 1) > 0.1 AS drift FROM d",
    "drift_multi_dimensional": f"""{_A}, s AS (SELECT model_id, drift_type, avg(score) / 100 AS score, bool_or(severity = 'critical') AS drift FROM drift_alerts GROUP BY ALL),
      m AS (SELECT model_id, avg(score) AS s, bool_or(drift) AS any_drift, coalesce(string_agg(CASE WHEN drift THEN drift_type END, ',' ORDER BY drift_type), '') AS causes FROM s GROUP BY 1)
      SELECT model_id, round(s, 8) AS score, any_drift, causes, CASE WHEN s < 0.1 THEN 'none' WHEN s < 0.25 THEN 'low' WHEN s < 0.5 THEN 'medium' WHEN s < 0.75 THEN 'high' ELSE 'critical' END AS severity FROM m""",
    "drift_correlation": f"""{_A}, d AS (SELECT date_trunc('day', detected_at) AS day, drift_type, avg(score) AS score FROM drift_alerts GROUP BY ALL)
      SELECT a.drift_type AS left_type, b.drift_type AS right_type, round(corr(a.score, b.score), 6) AS r, count(*) AS n FROM d a JOIN d b USING (day)
      WHERE a.drift_type < b.drift_type GROUP BY ALL HAVING count(*) >= 3 AND abs(coalesce(corr(a.score, b.score), 0)) >= 0.1""",
    "ddm": _OUTCOMES
    + """, p AS (SELECT key, ts, seq, count(*) OVER w AS n, avg(error) OVER w AS p FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p),
      b AS (SELECT *, min(CASE WHEN n >= 30 THEN {'l': round(p + s, 12), 'n': n, 'p': p, 's': s} END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS best FROM s)
      SELECT key, seq, n, round(p, 8) AS p, CASE WHEN n < 30 THEN 'stable' WHEN best.s = 0 THEN CASE WHEN p + s > best.p THEN 'drift' ELSE 'stable' END
        WHEN p + s >= best.p + 3 * best.s THEN 'drift' WHEN p + s >= best.p + 2 * best.s THEN 'warning' ELSE 'stable' END AS state FROM b""",
    "eddm": _OUTCOMES
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM o),
      g AS (SELECT *, i - lag(i) OVER (PARTITION BY key ORDER BY ts, seq) AS gap FROM i WHERE error = 1),
      l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n,
        avg(gap) OVER w + 2 * stddev_pop(gap) OVER w AS level FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS 999 PRECEDING)),
      r AS (SELECT *, round(level / nullif(max(CASE WHEN n >= 10 THEN level END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0), 8) AS ratio FROM l)
      SELECT key, seq, n, ratio, CASE WHEN n < 10 THEN 'stable' WHEN ratio < 0.5 THEN 'drift' WHEN ratio < 0.9 THEN 'warning' ELSE 'stable' END AS state FROM r""",
    "page_hinkley": _OUTCOMES
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n,
        error - coalesce(avg(error) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.005 AS step FROM o),
      b AS (SELECT *, sum(step) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM a),
      c AS (SELECT *, s - least(min(s) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS stat FROM b)
      SELECT key, min(n) AS n, arg_min(seq, n) AS seq, round(arg_min(stat, n), 4) AS stat FROM c WHERE n >= 30 AND stat > 5 GROUP BY 1""",
}
