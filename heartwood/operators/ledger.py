"""The ledger of runs: filters, totals and trends. ``seq`` is the order in which runs were appended."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heartwood.functions import costs

_HOURS = {"h": 1, "d": 24, "w": 7 * 24, "m": 30 * 24}
_FORMATS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ")
BLOCKS = "▁▂▃▄▅▆▇█"


def parse_since(since: str | None, now: datetime | None = None) -> str | None:
    """The least timestamp string that passes: from 12h, 7d, 4w, 2m (30 days each) or a date; None doesn't filter."""
    text = (since or "").strip()
    if m := re.fullmatch(r"(\d+)([hdwm])", text.lower()):
        at = (now or datetime.now(UTC)) - timedelta(hours=int(m[1]) * _HOURS[m[2]])
        return at.strftime("%Y-%m-%dT%H:%M:%S")
    for form in _FORMATS:
        try:
            return datetime.strptime(text, form).strftime("%Y-%m-%dT%H:%M:%S")
        except ValueError:
            continue
    return None


def since(runs: DataFrame, text: str | None, now: datetime | None = None) -> DataFrame:
    """Runs at or after the cut-off, compared as strings, so that the filter reaches the scan."""
    at = parse_since(text, now)
    return runs if at is None else runs.where(F.col("ts") >= at)


def exact_sum(c: str | Column) -> Column:
    """A sum of dollars that doesn't depend on the order of rows, rounded to six places."""
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.round(F.sum(column.cast("decimal(20,8)")), 6).cast("double"), F.lit(0.0))


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, F.round(hits / (hits + misses), 4)).otherwise(0.0)


def record(results: DataFrame) -> DataFrame:
    """Runs as the ledger keeps them: with tokens and dollars saved."""
    saved = costs.tokens_saved(F.col("cache_hits"), F.col("cache_misses"), F.col("tokens_used"))
    return results.withColumn("tokens_saved", saved).withColumn("cost_saved_usd", costs.estimate_cost(F.col("tokens_saved"), F.col("provider"), F.col("model")))


def board(runs: DataFrame) -> DataFrame:
    """One row of totals; zeros without runs."""
    return runs.agg(
        F.count("*").alias("run_count"), total("dirs_processed").alias("total_dirs_processed"), total("tokens_used").alias("total_tokens_used"), total("tokens_saved").alias("total_tokens_saved"),
        exact_sum("est_cost_usd").alias("total_cost_usd"), exact_sum("cost_saved_usd").alias("total_cost_saved_usd"),
        F.coalesce(hit_rate(F.sum("cache_hits"), F.sum("cache_misses")), F.lit(0.0)).alias("cache_hit_rate"),
    )


def per_model(runs: DataFrame) -> DataFrame:
    unknown = F.lit("unknown")
    key = F.concat(F.coalesce("provider", unknown), F.lit("/"), F.coalesce("model", unknown))
    return runs.groupBy(key.alias("model_key")).agg(F.count("*").alias("run_count"), total("tokens_used").alias("total_tokens_used"), exact_sum("est_cost_usd").alias("total_cost_usd"))


def per_repo(runs: DataFrame) -> DataFrame:
    return runs.groupBy("repo").agg(
        F.max_by("ts", "seq").alias("last_run"), F.count("*").alias("run_count"), total("dirs_processed").alias("total_dirs_processed"), total("tokens_used").alias("total_tokens_used"),
        total("tokens_saved").alias("total_tokens_saved"), exact_sum("est_cost_usd").alias("total_cost_usd"), exact_sum("cost_saved_usd").alias("total_cost_saved_usd"),
    )


def totals(runs: DataFrame) -> DataFrame:
    return per_repo(runs).agg(
        F.count("*").alias("repos_touched"), total("run_count").alias("total_runs"), total("total_dirs_processed").alias("total_dirs_processed"), total("total_tokens_used").alias("total_tokens_used"),
        total("total_tokens_saved").alias("total_tokens_saved"), exact_sum("total_cost_usd").alias("total_cost_usd"), exact_sum("total_cost_saved_usd").alias("total_cost_saved_usd"),
    )


def recent(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last n runs, newest first: a top-n, never a sort of the ledger."""
    return runs.orderBy(F.desc("seq")).limit(n)


def trend(runs: DataFrame, n: int = 20) -> DataFrame:
    """Cost and hit rate of the last n runs, oldest first."""
    last = recent(runs, n)
    return last.select("seq", "ts", "est_cost_usd", hit_rate(F.col("cache_hits"), F.col("cache_misses")).alias("cache_hit_rate")).orderBy("seq")


def sparkline(series: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """A string of eight block heights for each group's values in their order; a flat series is all of middle height."""
    span = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(span), F.max(value).over(span)
    step = F.when(hi == lo, 4).otherwise(F.least(F.floor((F.col(value) - lo) / (hi - lo) * 7), F.lit(7)))
    marked = series.select(*group, F.col(order).alias("__o"), F.substr(F.lit(BLOCKS), (step + 1).cast("int"), F.lit(1)).alias("__b"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__b"))), lambda x: x["__b"]), "")
    return marked.groupBy(*group).agg(line.alias("sparkline"))


def error_types(runs: DataFrame, message: str = "error") -> DataFrame:
    kind = costs.error_type(F.col(message))
    return runs.agg(*[F.count_if(kind == k).alias(k) for k in costs.ERROR_TYPES])


def csv_line(columns: list[str]) -> Column:
    """Values joined by commas without any quoting; null is empty."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A stored per_repo table with more runs added to it."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(per_repo(new).withColumn("__new", F.lit(1)))
    sums = [c for c in stored.columns if c not in ("repo", "last_run")]
    return both.groupBy("repo").agg(F.max_by("last_run", "__new").alias("last_run"), *[(exact_sum(c) if c.endswith("usd") else total(c)).alias(c) for c in sums])
