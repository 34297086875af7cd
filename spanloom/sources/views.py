"""The observability tables, derived from the tables of a data folder.

Every view is a plain projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import table

#: Model, provider, micro-dollars per million input and output tokens.
PRICES = [
    ("gpt-4o", "openai", 2500000, 10000000),
    ("gpt-4o-mini", "openai", 150000, 600000),
    ("gpt-4-turbo", "openai", 10000000, 30000000),
    ("gpt-4", "openai", 30000000, 60000000),
    ("gpt-3.5-turbo", "openai", 500000, 1500000),
    ("text-embedding-3-small", "openai", 20000, 0),
    ("text-embedding-3-large", "openai", 130000, 0),
    ("claude-3-opus", "anthropic", 15000000, 75000000),
    ("claude-3-sonnet", "anthropic", 3000000, 15000000),
    ("claude-3-haiku", "anthropic", 250000, 1250000),
    ("claude-3-5-sonnet", "anthropic", 3000000, 15000000),
    ("gemini-1.5-pro", "google", 3500000, 10500000),
    ("gemini-1.5-flash", "google", 75000, 300000),
    ("mistral-large", "mistral", 4000000, 12000000),
    ("mistral-medium", "mistral", 2700000, 8100000),
    ("mistral-small", "mistral", 1000000, 3000000),
]
#: From the second date on everything costs a tenth more.
PERIODS = (("1990-01-01", "1998-07-01", 100), ("1998-07-01", None, 110))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """One root span per event."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("model_"), F.col("user_id") % 5).alias("model_id"),
        F.concat(F.lit("provider_"), F.col("user_id") % 3).alias("provider"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value").alias("latency_ms"),
        k.alias("input_tokens"),
        (k * 2 + 7).alias("output_tokens"),
        (k * 5 + F.col("user_id")).alias("cost_micros"),
        F.col("event_id").alias("seq"),
    )


TRACES_SQL = """traces AS (
  SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS "timestamp", event_type AS service_name,
    'model_' || CAST(user_id % 5 AS VARCHAR) AS model_id, 'provider_' || CAST(user_id % 3 AS VARCHAR) AS provider,
    'user_' || CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    event_type = 'error' AS is_error, value AS latency_ms, k AS input_tokens, k * 2 + 7 AS output_tokens,
    k * 5 + user_id AS cost_micros, event_id AS seq
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def wide_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces with the further slice columns."""
    k = F.col("input_tokens")
    return traces(spark, folder).select(
        "*",
        F.concat(F.lit("feature_"), k % 6).alias("feature_id"),
        F.element_at(F.array(F.lit("prod"), F.lit("staging"), F.lit("dev")), (k % 3 + 1).cast("int")).alias("environment"),
        F.concat(F.lit("template_"), F.col("seq") % 4).alias("prompt_template"),
        (F.col("seq") % 11 / 10.0).alias("toxicity_score"),
        (F.col("seq") % 9 / 8.0).alias("hallucination_score"),
        (F.col("seq") % 7 / 7.0).alias("drift_score"),
    )


WIDE_SQL = """wide AS (
  SELECT *, 'feature_' || CAST(input_tokens % 6 AS VARCHAR) AS feature_id, (['prod', 'staging', 'dev'])[CAST(input_tokens % 3 + 1 AS INTEGER)] AS environment,
    'template_' || CAST(seq % 4 AS VARCHAR) AS prompt_template, seq % 11 / 10.0::DOUBLE AS toxicity_score, seq % 9 / 8.0::DOUBLE AS hallucination_score,
    seq % 7 / 7.0::DOUBLE AS drift_score FROM traces)"""


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluation per label: quality decides the verdict."""
    labels = table(spark, folder, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("trace_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id % 40000, 0)").alias("timestamp"),
        F.concat(F.lit("model_"), F.col("doc_id") % 5).alias("model_id"),
        F.lit("quality").alias("evaluator"),
        F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("warn").alias("verdict"),
        (F.col("quality") * 0.5 + (1 - F.col("toxic")) * 0.25 + (F.col("doc_id") % 4) * 0.0625).alias("score"),
        F.col("toxic").alias("toxic"),
        F.col("doc_id").alias("seq"),
    )


EVALUATIONS_SQL = """evaluations AS (
  SELECT CAST(doc_id AS VARCHAR) AS trace_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 40000) AS "timestamp",
    'model_' || CAST(doc_id % 5 AS VARCHAR) AS model_id, 'quality' AS evaluator,
    CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' ELSE 'warn' END AS verdict,
    quality * 0.5::DOUBLE + (1 - toxic) * 0.25::DOUBLE + (doc_id % 4) * 0.0625::DOUBLE AS score, toxic, doc_id AS seq
  FROM labels)"""


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """Token use: one row per order line."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    names = F.array(*(F.lit(p[0]) for p in PRICES))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trace_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.element_at(names, (F.col("l_partkey") % len(PRICES) + 1).cast("int")).alias("model_id"),
        F.concat(F.lit("user_"), F.col("o_custkey")).alias("user_id"),
        F.col("o_orderpriority").alias("feature_id"),
        (F.col("l_quantity") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("l_extendedprice") / 10).cast("long").alias("output_tokens"),
    )


_NAMES = ", ".join(f"'{p[0]}'" for p in PRICES)
USAGE_SQL = f"""usage AS (
  SELECT l_orderkey || '-' || l_linenumber AS trace_id, o_orderdate AS "timestamp",
    ([{_NAMES}])[CAST(l_partkey % {len(PRICES)} + 1 AS INTEGER)] AS model_id, 'user_' || o_custkey AS user_id,
    o_orderpriority AS feature_id, CAST(l_quantity * 100 AS BIGINT) AS input_tokens,
    CAST(floor(l_extendedprice / 10) AS BIGINT) AS output_tokens
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def pricing(spark: SparkSession) -> DataFrame:
    """Effective-dated prices: a fixed table of a few rows."""
    rows = [
        (m, p, i * factor // 100, o * factor // 100, start, until)
        for m, p, i, o in PRICES
        for start, until, factor in PERIODS
    ]
    frame = spark.createDataFrame(rows, "model_id string, provider string, input_price long, output_price long, since string, until string")
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


PRICING_SQL = "pricing AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{p}', {i * factor // 100}, {o * factor // 100}, TIMESTAMP '{start} 00:00:00', "
    + (f"TIMESTAMP '{until} 00:00:00'" if until else "CAST(NULL AS TIMESTAMP)") + ")"
    for m, p, i, o in PRICES
    for start, until, factor in PERIODS
) + ') AS v(model_id, provider, input_price, output_price, since, "until"))'


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Span trees: an order is a trace, its lines are spans; line k hangs under line k div 2."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("long").alias("span_id"))
    return lines.agg(F.max(F.col("l_quantity") * 1000).cast("long").alias("duration_ns"), F.max("l_suppkey").alias("service"), (F.max("l_suppkey") * 100).cast("long").alias("start_ns")).withColumn(
        "parent_span_id", F.when(F.col("span_id") > 1, F.expr("span_id div 2"))
    )


SPANS_SQL = """spans AS (
  SELECT *, CASE WHEN span_id > 1 THEN span_id // 2 END AS parent_span_id FROM (
    SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS span_id, CAST(max(l_quantity * 1000) AS BIGINT) AS duration_ns,
      max(l_suppkey) AS service, CAST(max(l_suppkey) * 100 AS BIGINT) AS start_ns FROM lineitem GROUP BY ALL))"""


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failure records: error events with a type from the user."""
    return traces(spark, folder).where("is_error").select(
        "trace_id",
        "timestamp",
        "model_id",
        "user_id",
        F.concat(F.lit("type_"), F.col("input_tokens") % 7).alias("failure_type"),
        "seq",
    )


FAILURES_SQL = """failures AS (
  SELECT trace_id, "timestamp", model_id, user_id, 'type_' || CAST(input_tokens % 7 AS VARCHAR) AS failure_type, seq
  FROM traces WHERE is_error)"""


def drift_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Drift alerts: purchases, with a severity by value."""
    e = table(spark, folder, "events").where("event_type = 'purchase'")
    return e.select(
        F.col("event_id").alias("alert_id"),
        F.concat(F.lit("model_"), F.col("user_id") % 5).alias("model_id"),
        F.concat(F.lit("feature_"), F.col("event_id") % 4).alias("feature"),
        F.element_at(F.array(*map(F.lit, ("feature", "embedding", "concept", "prediction"))), (F.col("event_id") % 4 + 1).cast("int")).alias("drift_type"),
        F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 60, "high").when(F.col("value") >= 30, "medium").otherwise("low").alias("severity"),
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"),
        F.col("value").alias("score"),
        F.col("ts").alias("detected_at"),
    )


DRIFT_ALERTS_SQL = """drift_alerts AS (
  SELECT event_id AS alert_id, 'model_' || CAST(user_id % 5 AS VARCHAR) AS model_id, 'feature_' || CAST(event_id % 4 AS VARCHAR) AS feature,
    (['feature', 'embedding', 'concept', 'prediction'])[CAST(event_id % 4 + 1 AS INTEGER)] AS drift_type,
    CASE WHEN value >= 100 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, value AS score, ts AS detected_at
  FROM events WHERE event_type = 'purchase')"""


def with_views(*views: str) -> str:
    """A WITH clause of the views' SQL."""
    return "WITH " + ", ".join(views) + " "
