"""Prices, budgets and token counts.  Money is integer micro-dollars throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_micros(tokens: str, price: str) -> Column:
    """Each side truncated on its own."""
    return F.expr(f"{tokens} * {price} div 1000000")


def _priced(joined: DataFrame) -> DataFrame:
    total = cost_micros("input_tokens", "input_price") + cost_micros("output_tokens", "output_price")
    return joined.select("trace_id", "model_id", "timestamp", F.coalesce(total, F.lit(0)).alias("cost_micros"), F.col("input_price").isNotNull().alias("priced"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def price_exact(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """By model name, at its newest price; unknown models cost 0 and are flagged.  Prices are a small fixed table."""
    now = latest(pricing, ["model_id"], "since").select("model_id", "input_price", "output_price")
    return _priced(usage.join(F.broadcast(now), "model_id", "left"))


def price_by_prefix(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """By the longest listed name that the model's name begins with; each name is looked up once."""
    now = latest(pricing, ["model_id"], "since").select(F.col("model_id").alias("prefix"), "input_price", "output_price")
    names = usage.select("model_id").distinct().join(F.broadcast(now), F.col("model_id").startswith(F.col("prefix")))
    best = names.groupBy("model_id").agg(F.max_by(F.struct("prefix", "input_price", "output_price"), F.length("prefix")).alias("p")).select("model_id", "p.*")
    return _priced(usage.join(best.drop("prefix"), "model_id", "left"))


def price_as_of(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """At the price in force at the time of use."""
    p = pricing.select(F.col("model_id").alias("m"), "input_price", "output_price", "since", "until")
    inside = (F.col("model_id") == F.col("m")) & (F.col("since") <= F.col("timestamp")) & (F.col("until").isNull() | (F.col("timestamp") < F.col("until")))
    return _priced(usage.join(F.broadcast(p), inside, "left"))


def period_start(column: str, period: str) -> Column:
    """Start of the hour, day, month, or of the week that begins on Sunday."""
    if period == "weekly":
        day = F.to_date(column)
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    return F.date_trunc({"hourly": "hour", "daily": "day", "monthly": "month"}[period], column).cast("timestamp_ntz")


def budget_status(spend: DataFrame, budgets: DataFrame, warn_percent: float = 80.0) -> DataFrame:
    """Spend of each budget's current period against its limits; both tables have dimension and value."""
    edge = spend.agg(F.max("timestamp").alias("as_of"))
    rows = []
    for period in ("daily", "weekly", "monthly"):
        own = budgets.where(F.col("period") == period)
        start = edge.select(period_start("as_of", period).alias("start"))
        inside = spend.join(F.broadcast(start)).where(F.col("timestamp") >= F.col("start"))
        total = inside.groupBy("dimension_value", "start").agg(F.sum("cost_micros").alias("spend"))
        rows.append(own.join(total, "dimension_value", "left"))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("spend", F.coalesce("spend", F.lit(0)))
    used = F.round(100.0 * F.col("spend") / F.col("hard_limit"), 6)
    state = (
        F.when(F.col("spend") >= F.col("hard_limit"), "hard")
        .when(F.col("spend") >= F.col("soft_limit"), "soft")
        .when(100.0 * F.col("spend") >= warn_percent * F.col("soft_limit"), "warning")
        .otherwise("ok")
    )
    return out.select("dimension_value", "period", "spend", "soft_limit", "hard_limit", used.alias("percent"), F.greatest(F.col("hard_limit") - F.col("spend"), F.lit(0)).alias("remaining"), state.alias("state"))


def token_estimate(text: Column) -> Column:
    """From words (1.3 tokens each), or from bytes where a text has no words."""
    words = F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != ""))
    return F.when(words > 0, F.floor(words * 1.3)).otherwise(F.floor(F.octet_length(text) / 4 + 0.5)).cast("long")


# Where providers keep token counts in their responses.
_INPUT = ("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usageMetadata.promptTokenCount", "$.meta.tokens.input_tokens", "$.meta.billed_units.input_tokens", "$.inputTextTokenCount", "$.prompt_token_count", "$.metadata.usage.prompt_tokens", "$.prompt_tokens", "$.input_tokens")
_OUTPUT = ("$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount", "$.meta.tokens.output_tokens", "$.meta.billed_units.output_tokens", "$.results[0].tokenCount", "$.generation_token_count", "$.metadata.usage.completion_tokens", "$.completion_tokens", "$.output_tokens")
_CACHED = ("$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens", "$.usageMetadata.cachedContentTokenCount")


_AUDIO = ("$.usage.prompt_tokens_details.audio_tokens", "$.usage.completion_tokens_details.audio_tokens")
_REASONING = ("$.usage.completion_tokens_details.reasoning_tokens", "$.usageMetadata.thoughtsTokenCount")


def token_details(body: Column) -> Column:
    """Audio tokens of prompt and completion together, and tokens of reasoning; absent ones are 0."""
    count = lambda path: F.coalesce(F.get_json_object(body, path).try_cast("long"), F.lit(0))
    return F.struct(reduce(Column.__add__, map(count, _AUDIO)).alias("audio_tokens"), F.greatest(*map(count, _REASONING)).alias("reasoning_tokens"))


def token_extract(body: Column) -> Column:
    """Token counts of a provider's JSON response, whatever provider it is; absent ones are 0."""

    def first(paths) -> Column:
        return F.coalesce(*(F.get_json_object(body, p).try_cast("long") for p in paths), F.lit(0))

    created = F.coalesce(F.get_json_object(body, "$.usage.cache_creation_input_tokens").try_cast("long"), F.lit(0))
    return F.struct(first(_INPUT).alias("input_tokens"), first(_OUTPUT).alias("output_tokens"), (first(_CACHED) + created).alias("cached_tokens"))


# Fixed values, in this order: parts of model names, and the provider they tell.
_PROVIDERS = [
    (("amazon.", "anthropic.claude", "meta.llama", "ai21."), "bedrock"),
    (("gpt-", "text-embedding", "davinci", "o1-"), "openai"),
    (("claude",), "anthropic"),
    (("gemini", "palm", "bison"), "google"),
    (("command", "cohere"), "cohere"),
    (("mistral", "mixtral"), "mistral"),
]


def provider_of(model: Column) -> Column:
    out = F
    low = F.lower(model)
    for parts, name in _PROVIDERS:
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(low, F.lit(part))
        out = out.when(found, name)
    return out.otherwise("unknown")


def _count(values: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(values, F.lit(n)).try_cast("long") for n in names), F.lit(0))


def _usage(input_: Column, output: Column, total: Column) -> Column:
    return F.struct(input_.alias("input_tokens"), output.alias("output_tokens"), F.when(total == 0, input_ + output).otherwise(total).alias("total_tokens"))


def tokens_from_headers(headers: Column) -> Column:
    """Counts from a response's headers, a map whose names may have any case; null where none has any."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    names = ("x-prompt-tokens", "x-completion-tokens", "x-total-tokens")
    some = F.array_contains(F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(low, n).try_cast("long").isNotNull()), True)
    return F.when(some, _usage(*(_count(low, n) for n in names)))


def tokens_from_attributes(attributes: Column) -> Column:
    """Counts from a span's attributes, by either convention of names; null where there are none."""
    pair = lambda old, new: _count(attributes, f"llm.usage.{old}", f"gen_ai.usage.{new}")
    input_, output = pair("prompt_tokens", "input_tokens"), pair("completion_tokens", "output_tokens")
    return F.when((input_ != 0) | (output != 0), _usage(input_, output, pair("total_tokens", "total_tokens")))


def provider_from_body(body: Column, hint: Column) -> Column:
    """The provider that a hint of the model tells, else the body's model, else fields that only one provider sends."""
    has = lambda *paths: reduce(Column.__or__, (F.get_json_object(body, p).isNotNull() for p in paths))
    told = lambda c: F.when(c.isNotNull() & (provider_of(c) != "unknown"), provider_of(c))
    shape = (
        F.when(has("$.stop_reason", "$.usage.input_tokens"), "anthropic")
        .when(has("$.usageMetadata", "$.candidates"), "google")
        .when(has("$.meta.billed_units"), "cohere")
        .when(has("$.usage.prompt_tokens"), "openai")
        .when(has("$.completion", "$.inputTextTokenCount"), "bedrock")
    )
    return F.coalesce(told(hint), told(F.get_json_object(body, "$.model")), shape, F.lit("unknown"))
