"""Queries over a tree; source / lang / document of ``documents`` stands in for it, ``doc_id`` for modification times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions import files, manifests
from heartwood.operators import health, ignore, tree
from heartwood.sources import git
from heartwood.sources.tables import table

_DIR = "coalesce(source, 'none') || '/' || coalesce(lang, 'none')"
_PATH = f"{_DIR} || '/' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 5 WHEN 0 THEN '.tmp' ELSE '.txt' END"
DEPTH = 2
RULES = ["# rules", "", "*.tmp", "!*1*.tmp", "src3/", "/src4/fr", "src5/**/*2.txt", "!src3/en/"]
BUDGET = 100_000


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path", "text")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(docs(spark, sf_dir))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = docs(spark, sf_dir).select("path", files.file_hash(F.col("text").cast("binary")).alias("hash"))
    return tree.merkle(nodes(spark, sf_dir), h, DEPTH)


_MIXED = "coalesce(source, 'none') || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || coalesce(lang, 'none') ELSE '/' || coalesce(lang, 'none') || '/deep' END || '/' || CAST(doc_id AS VARCHAR(20))"


def merkle_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that hold files and directories alike, names that end in 7 left out by a rule; the depth is asked of the tree."""
    d = table(spark, sf_dir, "documents").selectExpr(f"{_MIXED} AS path", "text")
    kept = ignore.keep(tree.nodes(d.select("path")), ["*7"])
    return tree.merkle(kept, d.select("path", files.file_hash(F.col("text").cast("binary")).alias("hash")))


_STORED = "length(path) % 5 <> 0"
_FRONT = {"ok": "length(path) % 7 <> 3", "content_hash": "CASE WHEN length(path) % 4 = 1 THEN '' WHEN length(path) % 4 = 2 THEN 'sha256:old' ELSE hash END", "tokens_total": "length(path) * 100", "model": "CASE WHEN length(path) % 3 = 0 THEN '' ELSE 'm' END"}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).where(_STORED).selectExpr("path", *[f"{e} AS {c}" for c, e in _FRONT.items()])


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health(hashes(spark, sf_dir), stored(spark, sf_dir))


def _changed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("doc_id") % k == 0).select("path")


def fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    return stored(spark, sf_dir).where("ok").select("path", F.lit("2024-01-01T00:00:00Z").alias("generated"), F.lit("g").alias("generator"), "model", "content_hash", zero.alias("files"), zero.alias("dirs"), "tokens_total")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = stored(spark, sf_dir).select("path", F.when(F.length("path") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return health.verify(checked(spark, sf_dir), fronts(spark, sf_dir), bodies)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.listing(nodes(spark, sf_dir)).select("path", F.array_join("files", ",").alias("files"), F.array_join("dirs", ",").alias("dirs"))


def mtime_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests older than the newest file beside them: a manifest is as old as its directory's last document of an even length."""
    d = table(spark, sf_dir, "documents").selectExpr(f"{_PATH} AS path", "doc_id AS mtime", "n_chars")
    m = d.where("n_chars % 2 = 0").groupBy(tree.parent_of(F.col("path")).alias("path")).agg(F.max("mtime").alias("mtime"))
    return git.older_than_siblings(d.select("path", "mtime"), m)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).groupBy(tree.parent_of(F.col("path")).alias("path")).agg(F.sum(F.coalesce(files.token_estimate(F.col("text")), F.lit(0))).alias("tokens"))
    return nodes(spark, sf_dir).where("is_dir").join(own, "path", "left").select("path", "depth", F.coalesce("tokens", F.lit(50)).alias("tokens"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select("path", F.concat(F.lit("text of "), "path").alias("text"))


def exported(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    parts = health.export(checked(spark, sf_dir), texts(spark, sf_dir), mode)
    return health.joined(parts.withColumn("top", F.substring_index("path", "/", 1)), ["top"], "\n" if mode == "missing" else "\n\n")


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level by level, deepest first: directories, how many are due, and how many of these the budget lets run."""
    due = checked(spark, sf_dir).select("path", (F.col("status") != "fresh").alias("due"))
    cut = health.budget_cutoff(_tokens(spark, sf_dir).join(due.where("due").select("path"), "path", "left_semi"), BUDGET)
    n = nodes(spark, sf_dir).where("is_dir").groupBy("depth").agg(F.count("*").alias("dirs"))
    ran = cut.groupBy("depth").agg(F.count("*").alias("due"), F.count_if("runs").alias("runs"))
    return n.join(ran, "depth", "left").select("depth", "dirs", F.coalesce("due", F.lit(0)).alias("due"), F.coalesce("runs", F.lit(0)).alias("runs"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 == 0).alias("force"), (F.col("event_id") % 3 != 0).alias("have"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2).alias("changed"))
    return e.select("event_id", health.strategy(F.col("force"), F.col("have"), F.col("changed")).alias("strategy"))


def ignored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.keep(nodes(spark, sf_dir), [r for r in ignore.rule_lines("\n".join(RULES))]).select("path")


_M = manifests.MANIFEST
QUERIES = {
    "tree_scan": lambda s, d: nodes(s, d).select("path", "name", "depth", "is_dir"),
    "dir_entries": listed,
    "bottom_up_order": lambda s, d: tree.bottom_up(nodes(s, d).where("is_dir")).select("path", "depth"),
    "ignore_filter": ignored_nodes,
    "merkle_hash": hashes,
    "merkle_mixed": merkle_mixed,
    "smart_targets": lambda s, d: tree.closure(_changed(s, d, 97)),
    "changed_union": lambda s, d: _changed(s, d, 6).union(_changed(s, d, 10)).distinct(),
    "diff_sets": lambda s, d: _changed(s, d, 6).subtract(_changed(s, d, 10)),
    "mtime_stale": mtime_stale,
    "health": lambda s, d: checked(s, d).withColumn("tokens_total", F.col("tokens_total").cast("string")),
    "health_summary": lambda s, d: health.summary(checked(s, d)),
    "coverage_stats": lambda s, d: health.coverage(checked(s, d)),
    "stale_dirs": lambda s, d: health.stale_dirs(checked(s, d), _changed(s, d, 97)).select("path", "status"),
    "verify_fields": lambda s, d: fronts(s, d).select("path", F.array_join(manifests.missing_fields(F.struct(*manifests.REQUIRED)), ",").alias("fields")).where("fields <> ''"),
    "verify_dirs": verified,
    "verify_summary": lambda s, d: health.verify_summary(checked(s, d), verified(s, d)),
    "budget_cutoff": lambda s, d: health.budget_cutoff(_tokens(s, d), BUDGET),
    "export_depth": lambda s, d: tree.within_depth(nodes(s, d).where("is_dir"), 1).select("path"),
    "export_filter": lambda s, d: exported(s, d, "missing"),
    "export_concat": lambda s, d: exported(s, d, "stale"),
    "reset_plan": lambda s, d: stored(s, d).select(F.when(F.col("path") == ".", _M).otherwise(F.concat("path", F.lit(f"/{_M}"))).alias("path")),
    "refresh_plan": refresh_plan,
    "strategy": strategies,
}

WITH = f"""WITH docs AS (SELECT doc_id, {_DIR} AS dir, coalesce(source, 'none') AS top, coalesce(lang, 'none') AS leaf, {_PATH} AS path, text FROM documents),
dirs AS (SELECT DISTINCT dir AS path, top AS parent, leaf AS name, 2 AS depth FROM docs UNION ALL SELECT DISTINCT top, '.', top, 1 FROM docs UNION ALL SELECT '.', NULL, '.', 0),
nodes AS (SELECT path, parent, name, depth, true AS is_dir FROM dirs UNION ALL SELECT path, dir, substr(path, length(dir) + 2), 3, false FROM docs),
leaves AS (SELECT dir AS parent, substr(path, length(dir) + 2) AS name, 'sha256:' || sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM docs),
h2 AS (SELECT parent AS path, 'sha256:' || sha256(string_agg(name || ':' || hash || chr(10), '' ORDER BY name)) AS hash FROM leaves GROUP BY parent),
h1 AS (SELECT parent AS path, 'sha256:' || sha256(string_agg(name || ':' || hash || chr(10), '' ORDER BY name)) AS hash FROM h2 JOIN dirs USING (path) GROUP BY parent),
h0 AS (SELECT parent AS path, 'sha256:' || sha256(string_agg(name || ':' || hash || chr(10), '' ORDER BY name)) AS hash FROM h1 JOIN dirs USING (path) GROUP BY parent),
hashes AS (SELECT path, 2 AS depth, hash FROM h2 UNION ALL SELECT path, 1, hash FROM h1 UNION ALL SELECT path, 0, hash FROM h0),
stored AS (SELECT path, {", ".join(f"{e} AS {c}" for c, e in _FRONT.items())} FROM hashes WHERE {_STORED}),
health AS (SELECT h.path, CASE WHEN s.path IS NULL THEN 'missing' WHEN NOT ok OR content_hash <> hash THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN ok THEN tokens_total END AS tokens_total, CASE WHEN NOT ok THEN 'invalid front matter' END AS error, model, content_hash FROM hashes h LEFT JOIN stored s USING (path)),
verified AS (SELECT path, CASE WHEN error IS NOT NULL THEN 'malformed' WHEN status = 'missing' THEN 'missing' WHEN model = '' OR content_hash = '' THEN 'missing_fields' WHEN status = 'stale' THEN 'stale' WHEN length(path) % 2 = 0 THEN 'invalid_body' END AS kind FROM health),
tokens AS (SELECT dirs.path, depth, CAST(coalesce(sum(CASE WHEN text IS NULL THEN 0 WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END) FILTER (docs.dir IS NOT NULL), 50) AS BIGINT) AS tokens FROM dirs LEFT JOIN docs ON docs.dir = dirs.path GROUP BY ALL)
"""
_TARGETS = "SELECT dir AS path FROM docs WHERE doc_id % 97 = 0 UNION SELECT top FROM docs WHERE doc_id % 97 = 0 UNION SELECT '.' FROM docs WHERE doc_id % 97 = 0"
_COUNTS = "count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'missing') AS missing"
_RUNNING = "CAST(coalesce(sum(tokens) OVER (ORDER BY depth DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
SQL = {
    "tree_scan": f"{WITH} SELECT path, name, depth, is_dir FROM nodes",
    "dir_entries": f"{WITH} SELECT d.path, coalesce(string_agg(n.name, ',' ORDER BY n.name) FILTER (NOT n.is_dir), '') AS files, coalesce(string_agg(n.name, ',' ORDER BY n.name) FILTER (n.is_dir), '') AS dirs FROM dirs d LEFT JOIN nodes n ON n.parent = d.path GROUP BY d.path",
    "bottom_up_order": f"{WITH} SELECT path, depth FROM dirs ORDER BY depth DESC, path",
    "ignore_filter": f"""{WITH} SELECT path FROM nodes WHERE NOT (path = 'src3' OR starts_with(path, 'src3/') OR path = 'src4/fr' OR starts_with(path, 'src4/fr/')
  OR (NOT is_dir AND ((path LIKE '%.tmp' AND NOT contains(name, '1')) OR (starts_with(path, 'src5/') AND name LIKE '%2.txt'))))""",
    "merkle_hash": f"{WITH} SELECT * FROM hashes",
    "merkle_mixed": f"""WITH docs AS (SELECT coalesce(source, 'none') AS top, coalesce(lang, 'none') AS leaf, doc_id % 3 AS k, CAST(doc_id AS VARCHAR) AS name, doc_id, text FROM documents WHERE NOT ends_with(coalesce(source, 'none'), '7')),
leaves AS (SELECT top || CASE k WHEN 0 THEN '' WHEN 1 THEN '/' || leaf ELSE '/' || leaf || '/deep' END AS parent, name, 'sha256:' || sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM docs WHERE NOT ends_with(name, '7')),
d3 AS (SELECT DISTINCT top || '/' || leaf || '/deep' AS path, top || '/' || leaf AS parent FROM docs WHERE k = 2), d2 AS (SELECT DISTINCT top || '/' || leaf AS path, top AS parent, leaf AS name FROM docs WHERE k > 0), d1 AS (SELECT DISTINCT top AS path FROM docs),
h3 AS (SELECT path, d3.parent, 'deep' AS name, 'sha256:' || sha256(coalesce(string_agg(l.name || ':' || hash || chr(10), '' ORDER BY l.name), '')) AS hash FROM d3 LEFT JOIN leaves l ON l.parent = path GROUP BY ALL),
c2 AS (SELECT * FROM leaves UNION ALL SELECT parent, name, hash FROM h3),
h2 AS (SELECT path, d2.parent, d2.name, 'sha256:' || sha256(coalesce(string_agg(l.name || ':' || hash || chr(10), '' ORDER BY l.name), '')) AS hash FROM d2 LEFT JOIN c2 l ON l.parent = path GROUP BY ALL),
c1 AS (SELECT * FROM leaves UNION ALL SELECT parent, name, hash FROM h2),
h1 AS (SELECT path, 'sha256:' || sha256(coalesce(string_agg(l.name || ':' || hash || chr(10), '' ORDER BY l.name), '')) AS hash FROM d1 LEFT JOIN c1 l ON l.parent = path GROUP BY ALL),
h0 AS (SELECT 'sha256:' || sha256(coalesce(string_agg(path || ':' || hash || chr(10), '' ORDER BY path), '')) AS hash FROM h1)
SELECT path, 3 AS depth, hash FROM h3 UNION ALL SELECT path, 2, hash FROM h2 UNION ALL SELECT path, 1, hash FROM h1 UNION ALL SELECT '.', 0, hash FROM h0""",
    "smart_targets": f"{WITH} {_TARGETS}",
    "changed_union": f"{WITH} SELECT DISTINCT path FROM docs WHERE doc_id % 6 = 0 OR doc_id % 10 = 0",
    "diff_sets": f"{WITH} SELECT DISTINCT path FROM docs WHERE doc_id % 6 = 0 AND doc_id % 10 <> 0",
    "mtime_stale": f"{WITH} SELECT dir AS path FROM (SELECT dir, max(doc_id) AS newest, max(doc_id) FILTER (n_chars % 2 = 0) AS mtime FROM docs JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY dir) WHERE newest > mtime",
    "health": f"{WITH} SELECT path, status, tokens_total::VARCHAR AS tokens_total, error FROM health",
    "health_summary": f"{WITH} SELECT count(*) AS total, {_COUNTS} FROM health",
    "coverage_stats": f"{WITH} SELECT count(*) AS dirs, count(*) FILTER (status <> 'missing') AS covered, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'stale') AS stale, CAST(coalesce(sum(tokens_total), 0) AS BIGINT) AS tokens FROM health",
    "stale_dirs": f"{WITH} SELECT path, status FROM health WHERE status <> 'fresh' AND path IN ({_TARGETS})",
    "verify_fields": f"{WITH} SELECT path, concat_ws(',', CASE WHEN model = '' THEN 'model' END, CASE WHEN content_hash = '' THEN 'content_hash' END) AS fields FROM stored WHERE ok AND (model = '' OR content_hash = '')",
    "verify_dirs": f"{WITH} SELECT path, kind AS status FROM verified WHERE kind IS NOT NULL",
    "verify_summary": f"{WITH} SELECT count(*) AS dirs, {_COUNTS}, (SELECT count(*) FROM verified WHERE kind IS NOT NULL) AS invalid, (SELECT count(*) FROM verified WHERE kind = 'invalid_body') AS invalid_body FROM health",
    "budget_cutoff": f"{WITH} SELECT *, running < {BUDGET} AS runs FROM (SELECT path, depth, tokens, {_RUNNING} AS running FROM tokens)",
    "export_depth": f"{WITH} SELECT path FROM dirs WHERE depth <= 1",
    "export_filter": f"{WITH} SELECT split_part(path, '/', 1) AS top, string_agg('# ' || CASE WHEN path = '.' THEN './' ELSE path || '/' END || ' [MISSING]', chr(10) ORDER BY path) AS content FROM health WHERE status = 'missing' GROUP BY 1",
    "export_concat": f"{WITH} SELECT split_part(path, '/', 1) AS top, string_agg('# ' || CASE WHEN path = '.' THEN '' ELSE path || '/' END || '{_M}' || chr(10) || chr(10) || 'text of ' || path, chr(10) || chr(10) ORDER BY path) AS content FROM health WHERE status = 'stale' GROUP BY 1",
    "reset_plan": f"{WITH} SELECT CASE WHEN path = '.' THEN '' ELSE path || '/' END || '{_M}' AS path FROM stored",
    "refresh_plan": f"{WITH}, due AS (SELECT depth, tokens, {_RUNNING} AS running FROM tokens JOIN health USING (path) WHERE status <> 'fresh') SELECT depth, count(*) AS dirs, (SELECT count(*) FROM due WHERE due.depth = dirs.depth) AS due, (SELECT count(*) FROM due WHERE due.depth = dirs.depth AND running < {BUDGET}) AS runs FROM dirs GROUP BY depth",
    "strategy": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'full' WHEN event_id % 4 <> 0 AND event_id % 2 = 1 THEN 'smart' ELSE 'incremental' END AS strategy FROM events",
}
