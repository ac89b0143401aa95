"""Queries over single files; ``documents`` stands in for files, its texts varied so that every rule has cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions import files
from heartwood.operators import summaries
from heartwood.sources.tables import table

_SUFFIXES = (".py", ".RS", ".tsx", ".go", ".h", ".md", "", ".tar.gz", ".exs")
_NAME = "'f' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIXES)) + " END"
_BODY = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 11 = 1 THEN text || chr(0) || 'x' ELSE text END"
WITH = f"WITH files AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_NAME} AS name, {_BODY} AS body, text FROM documents)"
_PROJECT = "CASE WHEN doc_id % 50 = 7 THEN 'go.mod' WHEN doc_id % 50 = 8 THEN 'Cargo.toml'"
_HASH = "'sha256:' || sha256(CASE WHEN contains(body, chr(0)) THEN body ELSE replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(source, '') AS source", "coalesce(lang, '') AS lang", f"{_NAME} AS name", f"CAST({_BODY} AS BINARY) AS content", "text")


def _one(name: str, column) -> object:
    return lambda s, d: rows(s, d).select("doc_id", column().alias(name))


def dir_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each directory: of its first project file, else of its most common suffix (ties: the first suffix by name)."""
    f = rows(spark, sf_dir).selectExpr("source", f"{_PROJECT} ELSE name END AS name")
    project = {n: (i, language) for i, (n, language) in enumerate(files.PROJECT_FILES)}
    order = F.try_element_at(F.create_map(*[F.lit(x) for n, (i, _) in project.items() for x in (n, i)]), F.col("name"))
    counts = f.groupBy("source", files.suffix(F.col("name")).alias("suffix")).agg(F.count("*").alias("n"), F.min(order).alias("order"))
    names = F.array(*[F.lit(language) for _, language in files.PROJECT_FILES])
    best = counts.groupBy("source").agg(F.min("order").alias("order"), F.min_by("suffix", F.struct(-F.col("n"), F.col("suffix"))).alias("suffix"))
    return best.select("source", F.coalesce(F.get(names, F.col("order")), F.try_element_at(files.literal_map(files.SUFFIXES), F.col("suffix"))).alias("language"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each directory: files, binary files, and tokens of what is left after truncation."""
    f = rows(spark, sf_dir).select("source", files.is_binary(F.col("content")).alias("bin"), files.token_estimate(files.truncate(files.read_text(F.col("content")))).alias("tokens"))
    return f.groupBy("source").agg(F.count("*").alias("files"), F.count_if("bin").alias("binary_files"), F.coalesce(F.sum(F.when(~F.col("bin"), F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests share a key: content, name and language count, the place in the tree doesn't."""
    key = summaries.cache_key(F.lit("m"), F.concat(F.lit("n"), (F.col("doc_id") % 3).cast("string")), F.col("lang"), F.col("text"))
    return rows(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("requests")).groupBy("requests").agg(F.count("*").alias("keys"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.col("doc_id").alias("seq"), "name")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir).where("seq % 4 = 0")
    return summaries.first_claims(r).select("key", "seq", F.concat(F.lit("Summary for "), F.col("name")).alias("summary"))


def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.lookup(_requests(spark, sf_dir), _cache(spark, sf_dir)).select("seq", "hit", "summary")


def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir).select("key", F.concat(F.lit("Summary for "), F.col("name")).alias("summary"), "seq")
    return summaries.evict(r, 100)


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("directory"), "name", F.coalesce(files.token_estimate(F.col("text")), F.lit(0)).alias("tokens"))
    return summaries.batches(r, 5)


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory entries with their answers back in place; answers are numbered among text files only."""
    b = batched(spark, sf_dir).select("directory", "position", "name", (F.col("position") % 4 == 0).alias("is_binary"), F.concat(F.lit("bin "), F.col("name")).alias("summary"))
    ask = b.where("NOT is_binary").drop("is_binary", "summary")
    answers = summaries.batches(ask.drop("position"), 5).select("directory", "position", F.concat(F.lit("Summary for "), F.col("name")).alias("text"))
    return summaries.zipped(b, answers)


def cache_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored cache as JSON text: its pairs; nothing where it is corrupt."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("[1")).otherwise(F.concat(F.lit('{"a'), F.col("event_id").cast("string"), F.lit('":"s","b":"t"}')))
    e = table(spark, sf_dir, "events").select("event_id", F.from_json(raw, "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "summary"))


_TEXT = "replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length({0}) / 4) AS INT)) END"
_IS_BINARY = "coalesce(CASE WHEN contains(body, chr(0)) THEN strlen(split_part(body, chr(0), 1)) < 8192 ELSE false END, true)"
_SUFFIX = "lower(regexp_extract(name, '[^/.][^/]*(\\.[^/.]+)$', 1))"
_LANGUAGE = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.SUFFIXES.items()) + " END"
_SIZE = "doc_id * 40000"
_BATCH = "batched AS (SELECT source || '/' || lang AS directory, name, coalesce({}, 0) AS tokens, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY name) AS position FROM files)".format(_TOKENS.format("text"))

QUERIES = {
    "text_read": _one("text", lambda: files.read_text(F.col("content"))),
    "file_hash": _one("hash", lambda: files.file_hash(F.col("content"))),
    "binary_filter": _one("is_binary", lambda: files.is_binary(F.col("content"))),
    "token_estimate": _one("tokens", lambda: files.token_estimate(F.col("text"))),
    "truncate": _one("text", lambda: files.truncate(F.col("text"))),
    "detect_language": _one("language", lambda: files.detect_language(F.col("name"))),
    "dir_language": dir_language,
    "binary_info": _one("info", lambda: files.binary_info(F.col("name"), F.col("doc_id") * 40000)),
    "collapse_ws": _one("text", lambda: files.collapse(F.col("text"))),
    "dir_totals": prepared,
    "cache_key": cache_keys,
    "cache_join": cache_join,
    "cache_first_claim": lambda s, d: summaries.first_claims(_requests(s, d)).select("key", "seq"),
    "cache_evict": evicted,
    "cache_load": cache_load,
    "batch_chunks": lambda s, d: batched(s, d).select("directory", "name", "position", "batch"),
    "batch_usage": lambda s, d: summaries.usage(batched(s, d)).select("directory", "name", "input_tokens", "output_tokens"),
    "summary_zip": zipped,
}
SQL = {
    "text_read": f"{WITH} SELECT doc_id, {_TEXT} AS text FROM files",
    "file_hash": f"{WITH} SELECT doc_id, {_HASH} AS hash FROM files",
    "binary_filter": f"{WITH} SELECT doc_id, {_IS_BINARY} AS is_binary FROM files",
    "token_estimate": f"{WITH} SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM files",
    "truncate": f"{WITH} SELECT doc_id, substr(text, 1, {files.MAX_FILE_CHARS}) AS text FROM files",
    "detect_language": f"{WITH} SELECT doc_id, {_LANGUAGE} AS language FROM files",
    "dir_language": f"""{WITH}, named AS (SELECT source, {_PROJECT} ELSE name END AS name FROM files), counts AS (SELECT source, {_SUFFIX} AS suffix, count(*) AS n FROM named GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, suffix) AS r FROM counts)
SELECT source, CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.source = ranked.source AND n.name = 'Cargo.toml') THEN 'Rust' WHEN EXISTS (SELECT 1 FROM named n WHERE n.source = ranked.source AND n.name = 'go.mod') THEN 'Go' ELSE {_LANGUAGE.replace(_SUFFIX, "suffix")} END AS language FROM ranked WHERE r = 1""",
    "binary_info": f"{WITH} SELECT doc_id, '[binary: ' || coalesce(nullif(substr({_SUFFIX}, 2), ''), 'unknown') || ', ' || CASE WHEN {_SIZE} < 1048576 THEN CAST(greatest(1, CAST(ceil({_SIZE} / 1024) AS BIGINT)) AS VARCHAR) || 'KB' ELSE regexp_replace(format('{{:.1f}}', round_even({_SIZE} / 1048576.0::DOUBLE, 1)), '\\.0$', '') || 'MB' END || ']' AS info FROM files",
    "collapse_ws": f"{WITH} SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B\\x{{0085}}\\p{{Z}}]+', ' ', 'g')) AS text FROM files",
    "dir_totals": f"{WITH} SELECT source, count(*) AS files, count(*) FILTER ({_IS_BINARY}) AS binary_files, CAST(coalesce(sum({_TOKENS.format(f'substr({_TEXT}, 1, 8000)')}) FILTER (NOT {_IS_BINARY}), 0) AS BIGINT) AS tokens FROM files GROUP BY source",
    "cache_key": f"{WITH}, keys AS (SELECT doc_id % 3 AS n, lang, text, count(*) AS requests FROM files GROUP BY ALL) SELECT requests, count(*) AS keys FROM keys GROUP BY requests",
    "cache_join": f"{WITH}, cache AS (SELECT sha256(text) AS key, 'Summary for ' || arg_min(name, doc_id) AS summary FROM files WHERE doc_id % 4 = 0 GROUP BY 1) SELECT doc_id AS seq, cache.key IS NOT NULL AS hit, summary FROM files LEFT JOIN cache ON sha256(text) = cache.key",
    "cache_first_claim": f"{WITH} SELECT sha256(text) AS key, min(doc_id) AS seq FROM files GROUP BY 1",
    "cache_evict": f"{WITH} SELECT sha256(text) AS key, 'Summary for ' || arg_max(name, doc_id) AS summary, min(doc_id) AS seq FROM files GROUP BY 1 ORDER BY seq DESC LIMIT 100",
    "cache_load": "SELECT event_id, unnest(['a' || event_id, 'b']) AS key, unnest(['s', 't']) AS summary FROM events WHERE event_id % 10 <> 0",
    "batch_chunks": f"{WITH}, {_BATCH} SELECT directory, name, position::INT AS position, ((position - 1) // 5)::INT AS batch FROM batched",
    "batch_usage": f"{WITH}, {_BATCH}, calls AS (SELECT *, (position - 1) // 5 AS batch FROM batched) SELECT directory, name, CAST(CASE WHEN (position - 1) % 5 = 0 THEN sum(tokens) OVER (PARTITION BY directory, batch) ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN (position - 1) % 5 = 0 THEN least(8192, greatest(1024, 256 + 128 * count(*) OVER (PARTITION BY directory, batch))) ELSE 0 END AS BIGINT) AS output_tokens FROM calls",
    "summary_zip": f"{WITH}, {_BATCH} SELECT directory, position::INT AS position, name, CASE WHEN position % 4 = 0 THEN 'bin ' ELSE 'Summary for ' END || name AS summary FROM batched",
}
