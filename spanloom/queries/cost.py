"""Prices, budgets and token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import cost as C
from spanloom.operators import sequential
from spanloom.sources import views as V
from spanloom.sources.tables import table

_U = V.with_views(V.USAGE_SQL, V.PRICING_SQL)
_T = V.with_views(V.TRACES_SQL)

_MODELS = "['gpt-4o-mini-2024', 'claude-3-opus', 'Gemini-pro', 'amazon.titan', 'command-r', 'mixtral-8x7b', 'o1-mini', 'llama-3']"
_PARTS = [
    (("amazon.", "anthropic.claude", "meta.llama", "ai21."), "bedrock"),
    (("gpt-", "text-embedding", "davinci", "o1-"), "openai"),
    (("claude",), "anthropic"),
    (("gemini", "palm", "bison"), "google"),
    (("command", "cohere"), "cohere"),
    (("mistral", "mixtral"), "mistral"),
]


def _suffixed(s, d):
    """Usage under dated model names."""
    u = V.usage(s, d)
    return u.withColumn("model_id", F.concat("model_id", F.lit("-"), F.pmod("input_tokens", F.lit(3))))


def _budgets(s):
    rows = [(f"provider_{p}", period, soft, 2 * soft) for p in range(3) for period, soft in (("daily", 20000 * (p + 1)), ("weekly", 300000), ("monthly", 90000 * 4 ** (2 - p)))]
    return s.createDataFrame(rows, "dimension_value string, period string, soft_limit long, hard_limit long")


_BUDGETS = ", ".join(
    f"('provider_{p}', '{period}', {soft}, {2 * soft})" for p in range(3) for period, soft in (("daily", 20000 * (p + 1)), ("weekly", 300000), ("monthly", 90000 * 4 ** (2 - p)))
)


def budget_status(s, d):
    return C.budget_status(V.traces(s, d).withColumnRenamed("provider", "dimension_value"), _budgets(s))


def latest_pricing(s, d):
    """Prices of brands as they were set one after the other: what holds now."""
    rows = table(s, d, "part").select(F.col("p_brand").alias("model_id"), F.col("p_partkey").alias("since"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("input_price"))
    return C.latest(rows, ["model_id"], "since")


def token_extract(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"usage": {"prompt_tokens": '), "k", F.lit(', "completion_tokens": 12, "prompt_tokens_details": {"cached_tokens": 3}}}')))
    body = body.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"usage": {"input_tokens": '), "k", F.lit(', "output_tokens": 7, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 4}}')))
    body = body.otherwise(F.concat(F.lit('{"usageMetadata": {"promptTokenCount": '), "k", F.lit("}}")))
    return e.select("event_id", C.token_extract(body).alias("t")).select("event_id", "t.*")


def provider_detect(s, d):
    names = F.expr(_MODELS.replace("[", "array(").replace("]", ")"))
    rows = table(s, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("model"))
    return rows.withColumn("provider", C.provider_of(F.col("model"))).groupBy("model", "provider").agg(F.count("*").alias("n"))


QUERIES = {
    "priced_traces_exact": lambda s, d: C.price_exact(V.usage(s, d), V.pricing(s)),
    "priced_traces_prefix": lambda s, d: C.price_by_prefix(_suffixed(s, d), V.pricing(s)),
    "priced_traces_asof": lambda s, d: C.price_as_of(V.usage(s, d), V.pricing(s)),
    "latest_pricing": latest_pricing,
    "budget_status": budget_status,
    "budget_alerts": lambda s, d: budget_status(s, d).where("state <> 'ok'").select("dimension_value", "period", "state", "percent"),
    "budget_admission": lambda s, d: sequential.admit(V.traces(s, d).select(F.col("user_id").alias("key"), "timestamp", "seq", F.col("cost_micros").alias("amount")), 3000),
    "token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", C.token_estimate(F.col("text")).alias("tokens")),
    "token_extract": token_extract,
    "provider_detect": provider_detect,
}

_PRICE = "input_tokens * input_price // 1000000 + output_tokens * output_price // 1000000"
_COLUMNS = f"""trace_id, model_id, "timestamp", coalesce({_PRICE}, 0) AS cost_micros, input_price IS NOT NULL AS priced"""


def _period(name: str) -> str:
    start = {"daily": "date_trunc('day', t)", "monthly": "date_trunc('month', t)", "weekly": "date_trunc('day', t) - to_days(CAST(dayofweek(t) AS INTEGER))"}[name]
    return f"""SELECT b.*, coalesce((SELECT sum(cost_micros) FROM traces WHERE provider = b.v AND "timestamp" >= (SELECT {start} FROM (SELECT max("timestamp") AS t FROM traces))), 0) AS spend
      FROM budgets b WHERE period = '{name}'"""


_STATUS = f"""{_T}, budgets AS (SELECT * FROM (VALUES {_BUDGETS}) AS x(v, period, soft_limit, hard_limit)),
  spent AS ({_period("daily")} UNION ALL {_period("weekly")} UNION ALL {_period("monthly")}),
  status AS (SELECT v AS dimension_value, period, CAST(spend AS BIGINT) AS spend, CAST(soft_limit AS BIGINT) AS soft_limit, CAST(hard_limit AS BIGINT) AS hard_limit,
    round(100.0::DOUBLE * spend / hard_limit, 6) AS percent, CAST(greatest(hard_limit - spend, 0) AS BIGINT) AS remaining,
    CASE WHEN spend >= hard_limit THEN 'hard' WHEN spend >= soft_limit THEN 'soft' WHEN 100 * spend >= 80 * soft_limit THEN 'warning' ELSE 'ok' END AS state FROM spent) """
_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(model), '{p}')" for p in parts) + f" THEN '{name}'" for parts, name in _PARTS
) + " ELSE 'unknown' END"

ORACLE_SQL = {
    "priced_traces_exact": f"""{_U} SELECT {_COLUMNS} FROM usage LEFT JOIN (SELECT * FROM pricing WHERE "until" IS NULL) p USING (model_id)""",
    "priced_traces_prefix": f"""{_U}, named AS (SELECT * REPLACE (model_id || '-' || CAST(input_tokens % 3 AS VARCHAR) AS model_id) FROM usage),
      best AS (SELECT n.model_id, arg_max(input_price, length(p.model_id)) AS input_price, arg_max(output_price, length(p.model_id)) AS output_price
        FROM (SELECT DISTINCT model_id FROM named) n JOIN pricing p ON starts_with(n.model_id, p.model_id) AND "until" IS NULL GROUP BY 1)
      SELECT {_COLUMNS} FROM named LEFT JOIN best USING (model_id)""",
    "priced_traces_asof": f"""{_U} SELECT u.trace_id, u.model_id, u."timestamp", coalesce({_PRICE}, 0) AS cost_micros, input_price IS NOT NULL AS priced
      FROM usage u ASOF LEFT JOIN pricing p ON u.model_id = p.model_id AND u."timestamp" >= p.since""",
    "latest_pricing": """SELECT model_id, since, input_price FROM (SELECT p_brand AS model_id, p_partkey AS since, CAST(round(p_retailprice * 1000) AS BIGINT) AS input_price,
      row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1""",
    "budget_status": _STATUS + "SELECT * FROM status",
    "budget_alerts": _STATUS + "SELECT dimension_value, period, state, percent FROM status WHERE state <> 'ok'",
    "token_estimate": r"""SELECT doc_id, CAST(CASE WHEN w > 0 THEN floor(w * 1.3::DOUBLE) ELSE floor(strlen(text) / 4 + 0.5) END AS BIGINT) AS tokens FROM (
      SELECT doc_id, text, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')) AS w FROM documents)""",
    "token_extract": """SELECT event_id, k AS input_tokens, CAST(CASE event_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 7 ELSE 0 END AS BIGINT) AS output_tokens,
      CAST(CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 0 END AS BIGINT) AS cached_tokens
      FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "provider_detect": f"""SELECT model, {_CASE} AS provider, count(*) AS n FROM (SELECT ({_MODELS})[CAST(event_id % 8 + 1 AS INTEGER)] AS model FROM events) GROUP BY ALL""",
}
