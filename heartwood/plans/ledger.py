"""Queries over the ledger; ``events`` stands in for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions import costs
from heartwood.operators import ledger
from heartwood.sources.tables import table

_RUN = {
    "seq": "event_id",
    "repo": "'repo' || CAST(user_id % 20 AS VARCHAR(9))",
    "provider": "CASE event_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'ollama' ELSE 'other' END",
    "model": "CASE event_type WHEN 'view' THEN 'x-claude-3-haiku' WHEN 'click' THEN 'GPT-4o-mini' WHEN 'error' THEN 'gpt-4.1' WHEN 'purchase' THEN 'claude-opus-4-x' END",
    "dirs_processed": "event_id % 9",
    "dirs_skipped": "event_id % 5",
    "tokens_used": "CAST(round(value * 100) AS BIGINT)",
    "est_cost_usd": "value",
    "cache_hits": "user_id % 11",
    "cache_misses": "event_id % 7",
    "error": "CASE event_id % 8 WHEN 0 THEN 'Request TIMEOUT after 5 s' WHEN 1 THEN 'timeout [Transient, retries exhausted]' WHEN 2 THEN 'Rate hit: LIMIT' WHEN 3 THEN 'Budget spent' WHEN 4 THEN 'disk full' END",
    "exhausted": "event_id % 2 = 0",
}
SINCE = "2024-01-15"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '.000Z' AS ts"
    return table(spark, sf_dir, "events").selectExpr(ts, *[f"{e} AS {c}" for c, e in _RUN.items()])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.record(results(spark, sf_dir))


def _price_sql() -> str:
    out = f"{costs.UNKNOWN_PRICE}::DOUBLE"
    for p, entries in costs.PRICES.items():
        own = f"{next(u for k, u in entries if k is None)}::DOUBLE"
        keyed = "".join(f" WHEN contains(lower(coalesce(model, '')), '{k}') THEN {u}::DOUBLE" for k, u in entries if k)
        own = f"CASE{keyed} ELSE {own} END" if keyed else own
        out = f"CASE WHEN lower(provider) = '{p}' THEN {own} ELSE {out} END"
    return out


_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'"
WITH = f"""WITH results AS (SELECT {_TS} AS ts, {", ".join(f"{e} AS {c}" for c, e in _RUN.items())} FROM events),
saved AS (SELECT *, CASE WHEN cache_hits + cache_misses > 0 THEN CAST(round_even(cache_hits / (cache_hits + cache_misses) * tokens_used, 0) AS BIGINT) ELSE 0 END AS tokens_saved FROM results),
runs AS (SELECT *, tokens_saved * {_price_sql()} / 1000000 AS cost_saved_usd FROM saved)
"""


def _usd(c: str) -> str:
    return f"CAST(round(sum(CAST({c} AS DECIMAL(20,8))), 6) AS DOUBLE)"


def _rate(h: str, m: str) -> str:
    return f"CASE WHEN {h} + {m} > 0 THEN round({h} / ({h} + {m}), 4) ELSE 0.0::DOUBLE END"


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in ("dirs_processed", "tokens_used", "tokens_saved"))
_BOARD = f"count(*) AS run_count, {_SUMS}, {_usd('est_cost_usd')} AS total_cost_usd, {_usd('cost_saved_usd')} AS total_cost_saved_usd"
_REPO = f"repos AS (SELECT repo, arg_max(ts, seq) AS last_run, {_BOARD} FROM runs GROUP BY repo)"
_LAST = "SELECT * FROM runs ORDER BY seq DESC LIMIT"
_CSV = ["ts", "dirs_processed", "tokens_used", "est_cost_usd", "model"]


def price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price list as data: a broadcast theta join, and the first entry that is part of the model's name."""
    p = F.broadcast(costs.price_table(spark))
    r = runs(spark, sf_dir).select("seq", "tokens_used", F.lower("provider").alias("provider"), F.lower(F.coalesce("model", F.lit(""))).alias("model"))
    hit = r.join(p, (r["provider"] == p["provider"]) & F.contains(r["model"], p["model_key"]), "left")
    usd = hit.groupBy(r["seq"], "tokens_used").agg(F.coalesce(F.min_by(p["usd"], p["ord"]), F.lit(costs.UNKNOWN_PRICE)).alias("usd"))
    return usd.select("seq", (F.col("tokens_used") * F.col("usd") / 1_000_000).alias("cost"))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, own = F.when(F.col("seq") % 3 != 0, F.lit(2000)), F.when(F.col("seq") % 2 == 0, F.lit(1500))
    return runs(spark, sf_dir).select("seq", costs.clamp_budget(own, limit).cast("string").alias("token_budget"))


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("seq") % 3 != 0, F.lit(2000))
    return runs(spark, sf_dir).select("seq", costs.budget_message(F.col("tokens_used"), limit, F.col("est_cost_usd"), F.lit(15.0)).alias("message"))


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON envelope for each repository: success, partial with errors, error where there is nothing but errors."""
    r = ledger.per_repo(runs(spark, sf_dir)).select("repo", "run_count", "total_tokens_used", "total_cost_usd", F.substring("repo", 5, 9).cast("int").alias("k"))
    bad = F.col("k") % 3 == 1
    status = F.when(~bad, "success").when(F.col("k") % 2 == 0, "error").otherwise("partial")
    errors = F.when(bad, F.array(F.struct(F.lit("budget_exhausted").alias("code"), F.lit("Token budget").alias("message")))).otherwise(F.array())
    meta = F.struct(F.lit("1").alias("version"), F.lit(0).alias("elapsed_ms"), F.col("total_tokens_used").alias("tokens_used"))
    body = F.struct(status.alias("status"), F.lit("stats").alias("command"), meta.alias("metadata"), F.struct("run_count").alias("data"), errors.alias("errors"), F.lit(None).cast("string").alias("recommended_next"))
    return r.select("repo", F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger documents as JSON text; what doesn't parse counts as the default."""
    raw = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(raw, "k bigint")["k"], F.lit(0)).alias("k"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of one run: counts add up, the last pass says which errors are left and whether the budget is spent."""
    return runs(spark, sf_dir).groupBy("repo").agg(
        ledger.total("dirs_processed").alias("dirs_processed"), ledger.total("tokens_used").alias("tokens_used"), F.max("dirs_skipped").alias("fallbacks"),
        F.max_by(F.coalesce("error", F.lit("")), "seq").alias("last_error"), F.max_by("exhausted", "seq").alias("budget_exhausted"),
    )


def _since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.since(runs(spark, sf_dir), SINCE)


QUERIES = {
    "board_aggregate": lambda s, d: ledger.board(runs(s, d)),
    "board_since": lambda s, d: ledger.board(_since(s, d)),
    "board_per_model": lambda s, d: ledger.per_model(runs(s, d)),
    "global_repos": lambda s, d: ledger.per_repo(runs(s, d)),
    "global_board": lambda s, d: ledger.totals(runs(s, d)),
    "recent_runs": lambda s, d: ledger.recent(runs(s, d)).select("seq", "ts", "repo", "model", "tokens_used", "est_cost_usd"),
    "trend": lambda s, d: ledger.trend(runs(s, d)),
    "sparkline": lambda s, d: ledger.sparkline(runs(s, d), ["repo"], "seq", "est_cost_usd"),
    "error_types": lambda s, d: ledger.error_types(runs(s, d)),
    "tokens_saved": lambda s, d: runs(s, d).select("seq", "tokens_saved"),
    "ledger_record": lambda s, d: runs(s, d).select("seq", "ts", "tokens_saved", "cost_saved_usd"),
    "ledger_load": loaded,
    "estimate_cost": lambda s, d: runs(s, d).select("seq", costs.estimate_cost(F.col("tokens_used"), F.col("provider"), F.col("model")).alias("cost")),
    "estimate_cost_join": price_join,
    "board_csv": lambda s, d: ledger.recent(runs(s, d)).select("seq", ledger.csv_line(_CSV).alias("line")),
    "budget_clamp": budget,
    "budget_message": message,
    "output_budget": lambda s, d: runs(s, d).select("seq", costs.output_budget(F.col("seq") % 80).alias("budget")),
    "fmt_elapsed": lambda s, d: runs(s, d).select("seq", costs.elapsed(F.col("tokens_used") / 8).alias("elapsed")),
    "run_totals": run_totals,
    "envelope": envelope,
}
_COST = f"SELECT seq, tokens_used * {_price_sql()} / 1000000 AS cost FROM runs"
_KIND = "CASE WHEN contains(lower(error), '[transient, retries exhausted]') THEN 'transient' WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), 'rate') AND contains(lower(error), 'limit') THEN 'rate_limit' WHEN contains(lower(error), 'budget') THEN 'budget' WHEN error IS NOT NULL THEN 'other' END"
SQL = {
    "board_aggregate": f"{WITH} SELECT {_BOARD}, {_rate('sum(cache_hits)', 'sum(cache_misses)')} AS cache_hit_rate FROM runs",
    "board_since": f"{WITH} SELECT {_BOARD}, {_rate('sum(cache_hits)', 'sum(cache_misses)')} AS cache_hit_rate FROM runs WHERE ts >= '{SINCE}T00:00:00'",
    "board_per_model": f"{WITH} SELECT coalesce(provider, 'unknown') || '/' || coalesce(model, 'unknown') AS model_key, count(*) AS run_count, CAST(sum(tokens_used) AS BIGINT) AS total_tokens_used, {_usd('est_cost_usd')} AS total_cost_usd FROM runs GROUP BY 1",
    "global_repos": f"{WITH}, {_REPO} SELECT * FROM repos",
    "global_board": f"{WITH}, {_REPO} SELECT count(*) AS repos_touched, CAST(sum(run_count) AS BIGINT) AS total_runs, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('total_dirs_processed', 'total_tokens_used', 'total_tokens_saved'))}, {_usd('total_cost_usd')} AS total_cost_usd, {_usd('total_cost_saved_usd')} AS total_cost_saved_usd FROM repos",
    "recent_runs": f"{WITH} SELECT seq, ts, repo, model, tokens_used, est_cost_usd FROM runs ORDER BY seq DESC LIMIT 5",
    "trend": f"{WITH} SELECT seq, ts, est_cost_usd, {_rate('cache_hits', 'cache_misses')} AS cache_hit_rate FROM ({_LAST} 20) ORDER BY seq",
    "sparkline": f"{WITH}, spans AS (SELECT repo, seq, est_cost_usd AS v, min(est_cost_usd) OVER (PARTITION BY repo) AS lo, max(est_cost_usd) OVER (PARTITION BY repo) AS hi FROM runs) SELECT repo, string_agg(substr('{ledger.BLOCKS}', CAST(CASE WHEN hi = lo THEN 4 ELSE least(floor((v - lo) / (hi - lo) * 7), 7) END AS INT) + 1, 1), '' ORDER BY seq) AS sparkline FROM spans GROUP BY repo",
    "error_types": f"{WITH} SELECT {', '.join(f'''count(*) FILTER (kind = '{k}') AS {k}''' for k in costs.ERROR_TYPES)} FROM (SELECT {_KIND} AS kind FROM runs)",
    "tokens_saved": f"{WITH} SELECT seq, tokens_saved FROM runs",
    "ledger_record": f"{WITH} SELECT seq, ts, tokens_saved, cost_saved_usd FROM runs",
    "ledger_load": "SELECT event_id, coalesce(CASE WHEN json_valid(p) THEN CAST(json_extract(p, '$.k') AS BIGINT) END, 0) AS k FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 3) ELSE props END AS p FROM events)",
    "estimate_cost": f"{WITH} {_COST}",
    "estimate_cost_join": f"{WITH} {_COST}",
    "board_csv": f"{WITH} SELECT seq, concat_ws(',', {', '.join(f'''coalesce(CAST({c} AS VARCHAR), '')''' for c in _CSV)}) AS line FROM ({_LAST} 5)",
    "budget_clamp": f"{WITH} SELECT seq, least(CASE WHEN seq % 2 = 0 THEN 1500 END, CASE WHEN seq % 3 <> 0 THEN 2000 END)::INT::VARCHAR AS token_budget FROM runs",
    "budget_message": f"{WITH} SELECT seq, CASE WHEN seq % 3 <> 0 AND tokens_used >= 2000 THEN format('Token budget guardrail reached: {{:,}} tokens used (limit 2,000).', tokens_used) WHEN est_cost_usd >= 15 THEN format('USD budget guardrail reached: ${{:.4f}} estimated spend (limit $15.0000).', est_cost_usd) END AS message FROM runs",
    "output_budget": f"{WITH} SELECT seq, CAST(least(8192, greatest(1024, 256 + 128 * (seq % 80))) AS INT) AS budget FROM runs",
    "fmt_elapsed": f"{WITH} SELECT seq, CASE WHEN tokens_used / 8 < 60 THEN format('{{:.1f}}s', round_even(tokens_used / 8, 1)) ELSE format('{{}}m {{}}s', CAST(floor(tokens_used / 8 / 60) AS BIGINT), CAST(floor((tokens_used / 8) % 60) AS BIGINT)) END AS elapsed FROM runs",
    "run_totals": f"{WITH} SELECT repo, CAST(sum(dirs_processed) AS BIGINT) AS dirs_processed, CAST(sum(tokens_used) AS BIGINT) AS tokens_used, max(dirs_skipped) AS fallbacks, arg_max(coalesce(error, ''), seq) AS last_error, arg_max(exhausted, seq) AS budget_exhausted FROM runs GROUP BY repo",
    "envelope": f"""{WITH}, {_REPO}, k AS (SELECT *, CAST(substr(repo, 5) AS INT) AS k FROM repos)
SELECT repo, CAST(json_object('status', CASE WHEN k % 3 <> 1 THEN 'success' WHEN k % 2 = 0 THEN 'error' ELSE 'partial' END, 'command', 'stats', 'metadata', json_object('version', '1', 'elapsed_ms', 0, 'tokens_used', total_tokens_used),
  'data', json_object('run_count', run_count), 'errors', CASE WHEN k % 3 = 1 THEN json_array(json_object('code', 'budget_exhausted', 'message', 'Token budget')) ELSE json_array() END, 'recommended_next', NULL) AS VARCHAR) AS envelope FROM k""",
}
