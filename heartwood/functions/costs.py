"""Prices, budgets and error classes of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: provider: (part of a model's name, USD for a million tokens), in order of precedence. None is the provider's default.
PRICES: dict[str, list[tuple[str | None, float]]] = {
    "anthropic": [("claude-opus-4", 15.0), ("claude-sonnet-4", 3.0), ("claude-haiku-4-5", 0.8), ("claude-3-opus", 15.0), ("claude-3-sonnet", 3.0), ("claude-3-haiku", 0.25), (None, 0.8)],
    "openai": [("gpt-4.1", 2.0), ("gpt-4o", 2.5), ("gpt-4-o", 2.5), ("gpt-4", 30.0), ("gpt-3.5-turbo", 0.5), ("gpt-3.5", 0.5), (None, 2.5)],
    "ollama": [(None, 0.0)],
    "lmstudio": [(None, 0.0)],
}
UNKNOWN_PRICE = 3.0
ERROR_TYPES = ("transient", "timeout", "rate_limit", "budget", "other")


def price(provider: Column, model: Column, prices: dict[str, list[tuple[str | None, float]]] = PRICES) -> Column:
    """USD for a million tokens: the provider's first entry whose name is part of the model's."""
    provider, model = F.lower(provider), F.lower(F.coalesce(model, F.lit("")))
    out = F.lit(UNKNOWN_PRICE)
    for p, entries in prices.items():
        own = F.lit(next((usd for key, usd in entries if key is None), UNKNOWN_PRICE))
        for key, usd in reversed([e for e in entries if e[0] is not None]):
            own = F.when(F.contains(model, F.lit(key)), F.lit(usd)).otherwise(own)
        out = F.when(provider == p, own).otherwise(out)
    return out


def estimate_cost(tokens: Column, provider: Column, model: Column) -> Column:
    return tokens * price(provider, model) / F.lit(1_000_000)


def price_table(spark: SparkSession) -> DataFrame:
    """The prices as a table, for joins with a price list that comes as data."""
    rows = [(p, key or "", i, usd) for p, entries in PRICES.items() for i, (key, usd) in enumerate(entries)]
    return spark.createDataFrame(rows, "provider string, model_key string, ord int, usd double")


def tokens_saved(hits: Column, misses: Column, tokens: Column) -> Column:
    """The share of look-ups that hit, of the tokens used, rounded half to even."""
    return F.when(hits + misses > 0, F.bround(hits / (hits + misses) * tokens).cast("long")).otherwise(F.lit(0).cast("long"))


def error_type(message: Column) -> Column:
    low = F.lower(message)
    has = lambda s: F.contains(low, F.lit(s))
    rules = [("transient", has("[transient, retries exhausted]")), ("timeout", has("timeout")), ("rate_limit", has("rate") & has("limit")), ("budget", has("budget"))]
    return F.when(message.isNull(), None).otherwise(reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit("other")))


def output_budget(files: Column) -> Column:
    return F.least(F.lit(8192), F.greatest(F.lit(1024), files * 128 + 256)).cast("int")


def clamp_budget(budget: Column, ceiling: Column) -> Column:
    """The stricter of two optional limits."""
    return F.least(budget, ceiling)


def budget_message(tokens: Column, max_tokens: Column, cost: Column, max_usd: Column) -> Column:
    """Why a run has to stop; null while it may go on. Tokens come before dollars."""
    over_tokens = F.format_string("Token budget guardrail reached: %s tokens used (limit %s).", F.format_number(tokens, 0), F.format_number(max_tokens, 0))
    over_usd = F.format_string("USD budget guardrail reached: $%.4f estimated spend (limit $%.4f).", cost, max_usd)
    return F.when(tokens >= max_tokens, over_tokens).when(cost >= max_usd, over_usd)


def elapsed(seconds: Column) -> Column:
    whole = F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds % 60))
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1))).otherwise(whole)
