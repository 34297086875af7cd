"""Rules and evaluators from JSON, scrubbing, the vector store, merged clusters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanloom.operators import rca, rules, scrubbing, vector_store
from spanloom.queries.evals import _SIM, _TURNS, _turns
from spanloom.session import Workspace
from spanloom.sources import views as V
from spanloom.sources.tables import table

_T = V.with_views(V.TRACES_SQL)


def _points(s, d):
    """Three metrics of every trace."""
    t = V.traces(s, d)
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("x")) for n, c in (("latency", "latency_ms"), ("tokens", "input_tokens"), ("errors", "is_error"))))
    return t.select(F.col("model_id").alias("key"), "timestamp", "seq", F.explode(each).alias("m")).select("key", "timestamp", "seq", "m.metric", "m.x")


_POINTS = _T + """, p AS (SELECT model_id AS key, "timestamp", seq, metric, x FROM (
    SELECT model_id, "timestamp", seq, 'latency' AS metric, latency_ms AS x FROM traces UNION ALL SELECT model_id, "timestamp", seq, 'tokens', CAST(input_tokens AS DOUBLE) FROM traces
    UNION ALL SELECT model_id, "timestamp", seq, 'errors', CAST(is_error AS DOUBLE) FROM traces))"""

#: A file of a hundred rules: thresholds by metric, comparison, value and run, and what combines them.
_LIMITS = [(m, c, v, k) for m, values in (("latency", (20, 40, 60, 80)), ("tokens", (5, 30, 60, 90))) for c in ("greater_than", "less_than_or_equal", "not_equal") for v in values for k in (1, 2, 4, 6)]
RULES = json.dumps({"rules": [
    *({"rule_id": f"t{i:02}", "name": f"{m} {c} {v} for {k}", "type": "threshold", "severity": rules.SEVERITIES[i % 4], "config": {"metric_name": m, "comparison": c, "threshold": v, "consecutive_count": k}} for i, (m, c, v, k) in enumerate(_LIMITS)),
    {"rule_id": "odd", "name": "odd", "type": "anomaly", "severity": "error", "config": {"metric_name": "latency", "std_dev_threshold": 2.5, "min_samples": 50}},
    {"rule_id": "fast", "name": "fast", "type": "rate", "config": {"metric_name": "tokens", "rate_threshold": 0.2, "window_seconds": 600}},
    {"rule_id": "both", "name": "both", "type": "composite", "severity": "critical", "config": {"rule_ids": ["t08", "odd"]}},
    {"rule_id": "off", "name": "off", "enabled": False, "config": {"metric_name": "latency"}},
    {"rule_id": "wrong", "name": "wrong", "config": {"metric_name": "latency", "comparison": "above"}},
]})


def rules_from_json(s, d):
    book = rules.RuleBook(s, Workspace(s, "rules").root)
    book.put(RULES)
    return rules.evaluate(_points(s, d), book.rules())


def rule_counts(s, d):
    return rules_from_json(s, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("seq").alias("first_seq"))


_SQL_COMPARE = {"greater_than": "x > {}", "less_than_or_equal": "x <= {}", "not_equal": "abs(x - {}) >= 1e-9"}


def _threshold_sql() -> str:
    parts = []
    for i, (m, c, v, k) in enumerate(_LIMITS):
        bad = _SQL_COMPARE[c].format(v)
        parts.append(f"SELECT 't{i:02}' AS rule_id, '{rules.SEVERITIES[i % 4]}' AS severity, key, \"timestamp\", seq, {bad} AS bad, {k} AS k FROM p WHERE metric = '{m}'")
    return f"""v AS ({' UNION ALL '.join(parts)}),
      i AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY rule_id, key ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS island FROM v),
      t AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY rule_id, key, island ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS run FROM i),
      fired AS (SELECT rule_id, severity, key, seq, CAST(run AS DOUBLE) AS value FROM t WHERE bad AND run >= k)"""


_RULES_SQL = f"""{_POINTS}, {_threshold_sql()},
  a AS (SELECT key, seq, x, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM p WHERE metric = 'latency'
    WINDOW w AS (PARTITION BY key ORDER BY "timestamp" RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)),
  odd AS (SELECT 'odd' AS rule_id, 'error' AS severity, key, seq, round((x - m) / s, 6) AS value FROM a WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 2.5),
  r AS (SELECT key, seq, x, first_value(x) OVER w AS x0, epoch_us("timestamp") AS t1, min(epoch_us("timestamp")) OVER w AS t0 FROM (SELECT * FROM p WHERE metric = 'tokens')
    WINDOW w AS (PARTITION BY key ORDER BY "timestamp" RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)),
  fast AS (SELECT 'fast' AS rule_id, 'warning' AS severity, key, seq, round((x - x0) / ((t1 - t0) / 1e6), 6) AS value FROM r WHERE t1 > t0 AND abs((x - x0) / ((t1 - t0) / 1e6)) > 0.2),
  alone AS (SELECT * FROM fired UNION ALL SELECT * FROM odd UNION ALL SELECT * FROM fast),
  every AS (SELECT * FROM alone UNION ALL SELECT 'both', 'critical', key, seq, 2.0 FROM alone WHERE rule_id IN ('t08', 'odd') GROUP BY key, seq HAVING count(DISTINCT rule_id) = 2)"""

EVALUATORS = json.dumps([
    {"name": "short", "config": {"max_length": 300}},
    {"name": "talks", "tags": ["style"], "config": {"condition": "len(output) > 40 && input_len < 2000", "required": ["th"], "forbidden": ["xyzzy", "ereth"]}},
    {"name": "ends", "tags": ["style"], "config": {"patterns": ["[.!?]$"], "min_length": 5}},
    {"name": "off", "enabled": False, "config": {"min_length": 1}},
    {"name": "script", "type": "script", "config": {"code": "1"}},
    {"name": "torn", "config": {"condition": "len(output) >> 3"}},
])


def evaluators_from_json(s, d):
    good, _ = rules.evaluators(EVALUATORS)
    return rules.run_evaluators(_turns(s, d).select("id", F.col("question").alias("input"), F.col("answer").alias("output")), good)


def scrub_documents(s, d):
    docs = scrubbing.scrub(table(s, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5("text").alias("scrubbed_md5"))


def scrub_nested(s, d):
    """Texts in a struct, a map, an array of structs and a JSON column; all come out as the plain one does."""
    t = table(s, d, "documents").select("doc_id", F.struct(F.col("text").alias("a"), F.array(F.struct(F.col("text").alias("b"), F.col("doc_id").alias("n"))).alias("c")).alias("s"), F.create_map(F.lit("k"), "text").alias("m"), F.to_json(F.struct(F.array("text").alias("t"), "doc_id")).alias("j"))
    out = scrubbing.scrub(t, json_columns=["j"])
    return out.select("doc_id", F.md5("s.a").alias("in_struct"), F.md5(F.col("s.c")[0]["b"]).alias("in_array"), F.col("s.c")[0]["n"].alias("n"), F.md5(F.col("m")["k"]).alias("in_map"), F.md5(F.get_json_object("j", "$.t[0]")).alias("in_json"))


def _scrub_sql() -> str:
    out = "text"
    for _, pattern, new in scrubbing.PATTERNS:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{new}', 'g')"
    return out


def _store(s, d):
    """Vectors in two batches; some are changed, some are deleted, half-way the store is compacted."""
    folder, rows = Workspace(s, "vectors").root, table(s, d, "embeddings")
    size = 64
    points = rows.select("vec_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("side"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")).alias("payload"))
    vector_store.create(s, folder, size)
    vector_store.upsert(folder, points.where("vec_id % 3 < 2"))
    vector_store.upsert(folder, points.where("vec_id % 3 = 2"))
    vector_store.delete(folder, points.where("vec_id % 7 = 3").select("vec_id"))
    vector_store.compact(s, folder)
    vector_store.upsert(folder, points.where("vec_id % 11 = 5").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    vector_store.delete(folder, points.where("vec_id % 13 = 1").select("vec_id"))
    vector_store.upsert(folder, points.where("vec_id % 26 = 1"))
    return folder


def vector_store_search(s, d):
    queries = table(s, d, "embeddings").where("vec_id % 20 = 0")
    return vector_store.search(s, _store(s, d), queries, 5, [("side", "eq", "odd"), ("label", "in", "1,2,3,5,8")])


def vector_store_points(s, d):
    return vector_store.current(s, _store(s, d)).groupBy(F.col("payload")["label"].alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0]), 4).alias("first"))


_STORE = """WITH points AS (SELECT vec_id, CAST(CASE WHEN vec_id % 11 = 5 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS DOUBLE[]) AS a, label, vec_id % 2 = 1 AS odd, embedding FROM embeddings
    WHERE (vec_id % 7 <> 3 OR vec_id % 11 = 5) AND vec_id % 13 <> 1
    UNION ALL SELECT vec_id, CAST(embedding AS DOUBLE[]), label, vec_id % 2 = 1, embedding FROM embeddings WHERE vec_id % 26 = 1)"""


def clusters_merged(s, d):
    """Documents by source and language as clusters of a text and its frequent words; copies of texts merge."""
    docs = table(s, d, "documents").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("cluster"), F.col("text").alias("representative"), F.array(F.lower("lang"), "source").alias("keywords"), F.lit(1).cast("long").alias("size"))
    return rca.merged_sizes(rca.merge_clusters(Workspace(s, "merge"), rows, 0.9, 0.7, 0.3))


QUERIES = {
    "rules_from_json": rules_from_json,
    "rule_counts": rule_counts,
    "evaluators_from_json": evaluators_from_json,
    "scrub_documents": scrub_documents,
    "scrub_nested": scrub_nested,
    "vector_store_search": vector_store_search,
    "vector_store_points": vector_store_points,
    "clusters_merged": clusters_merged,
}

ORACLE_SQL = {
    "rules_from_json": f"{_RULES_SQL} SELECT * FROM every",
    "rule_counts": f"{_RULES_SQL} SELECT rule_id, severity, count(*) AS n, count(DISTINCT key) AS keys, min(seq) AS first_seq FROM every GROUP BY ALL",
    "evaluators_from_json": f"""{_TURNS}, e AS (
        SELECT id, 'short' AS evaluator, list_filter([CASE WHEN NOT length(answer) <= 300 THEN 'max_length' END], lambda x: x IS NOT NULL) AS f, 1 AS parts FROM t
        UNION ALL SELECT id, 'talks', list_filter([CASE WHEN NOT (length(answer) > 40 AND length(question) < 2000) THEN 'condition' END, CASE WHEN NOT contains(lower(answer), 'th') THEN 'required:th' END,
          CASE WHEN contains(lower(answer), 'xyzzy') THEN 'forbidden:xyzzy' END, CASE WHEN contains(lower(answer), 'ereth') THEN 'forbidden:ereth' END], lambda x: x IS NOT NULL), 4 FROM t
        UNION ALL SELECT id, 'ends', list_filter([CASE WHEN NOT regexp_matches(answer, '[.!?]$') THEN 'pattern:[.!?]$' END, CASE WHEN NOT length(answer) >= 5 THEN 'min_length' END], lambda x: x IS NOT NULL), 2 FROM t)
      SELECT id, evaluator, CASE WHEN len(f) = 0 THEN 'pass' ELSE 'fail' END AS verdict, round(1 - len(f) / parts, 6) AS score, array_to_string(f, ',') AS failures FROM e""",
    "scrub_documents": f"SELECT doc_id, md5({_scrub_sql()}) AS scrubbed_md5 FROM documents",
    "scrub_nested": f"SELECT doc_id, m AS in_struct, m AS in_array, doc_id AS n, m AS in_map, m AS in_json FROM (SELECT doc_id, md5({_scrub_sql()}) AS m FROM documents)",
    "vector_store_search": f"""{_STORE}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id % 20 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT query_id, vec_id, round({_SIM['cosine']}, 6) AS score FROM points JOIN q ON vec_id <> query_id WHERE odd AND label IN (1, 2, 3, 5, 8))) WHERE rank <= 5""",
    "vector_store_points": f"{_STORE} SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, round(sum(a[1]), 4) AS first FROM points GROUP BY 1",
}
