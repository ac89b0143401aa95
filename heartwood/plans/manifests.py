"""Queries over manifests, rendered from the tree of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions import manifests
from heartwood.operators import summaries, tree
from heartwood.plans import tree as trees

_FILES, _DIRS = "files", "dirs"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, files, dirs, body): every directory's body by its true children."""
    listing = tree.listing(trees.nodes(spark, sf_dir))

    def named(c: str, tail: str) -> F.Column:
        return F.transform(c, lambda n: F.struct(n.alias("name"), F.concat(F.lit("Summary of "), n, F.lit(tail)).alias("summary")))

    notes = F.when(F.contains("path", F.lit("/")), F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), F.lit("two")))
    purpose = F.concat(F.lit("Holds "), "path", F.lit(". "))
    return listing.withColumn("body", manifests.render_body(F.col("path"), purpose, named(_FILES, ""), named(_DIRS, "/"), notes))


def front(path: F.Column) -> dict[str, F.Column]:
    size = F.length(path)
    return {"generated": F.lit("2024-01-01T00:00:00Z"), "generator": F.lit("g/1"), "model": F.lit("m"), "content_hash": F.concat(F.lit("sha256:"), path), "files": F.size("files"), "dirs": F.size("dirs"), "tokens_total": size * 10}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir)
    whole = manifests.render(front(F.col("path")), F.col("body"))
    broken = F.length("path") % 7 == 3
    return r.withColumn("text", F.when(broken, F.substring(whole, 5, 1 << 30)).otherwise(whole))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = texts(spark, sf_dir).select("path", manifests.parse(F.col("text")).alias("m"))
    return m.select("path", "m.ok", "m.generated", "m.model", "m.content_hash", *[F.col(f"m.{c}").cast("string").alias(c) for c in ("files", "dirs", "tokens_total")], "m.body")


def verify_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.length("path") % 5
    body = F.when(kind == 1, F.regexp_replace("body", "^# ", "#")).when(kind == 2, F.replace("body", F.lit("## Files"), F.lit("## Fils"))).when(kind == 4, F.replace("body", F.lit("/** — "), F.lit("** — "))).otherwise(F.col("body"))
    n = F.size("files") + F.when(kind == 3, 1).otherwise(0)
    issues = manifests.validate(F.col("path"), body, n, F.size("dirs"), F.col("files"), F.col("dirs"))
    return rendered(spark, sf_dir).select("path", F.array_join(issues, "|").alias("issues"))


def subdirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with the summaries of those children that have a sound manifest."""
    m = texts(spark, sf_dir).select("path", manifests.parse(F.col("text")).alias("m")).where("m.ok AND path <> '.'")
    return tree.children(m.select("path", manifests.summary_line(F.col("m.body"), tree.name_of(F.col("path"))).alias("summary"))).select("path", F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit(": "), c["summary"])), "|").alias("children"))


def json_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers around a JSON array; ``events`` gives as many as there are runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    k = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a  '), k, F.lit('", {"summary": "b"}]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Sure [x]: ["c\\n'), k, F.lit('"] done'))).otherwise(F.lit("no array"))
    return e.select("event_id", F.array_join(summaries.json_summaries(text), "|").alias("summaries"))


QUERIES = {
    "manifest_render": lambda s, d: texts(s, d).select("path", "text"),
    "manifest_parse": parsed,
    "manifest_summary": lambda s, d: rendered(s, d).select("path", manifests.summary_line(F.col("body"), F.col("path")).alias("summary")),
    "purpose_notes": lambda s, d: rendered(s, d).select("path", manifests.purpose_and_notes(F.col("body"), F.col("path")).alias("p")).select("path", "p.purpose", F.array_join("p.notes", ",").alias("notes")),
    "verify_body": verify_body,
    "subdir_summaries": subdirs,
    "json_summaries": json_summaries,
}

_BULLETS = "coalesce(string_agg('- **' || n.name || '{1}** — Summary of ' || n.name || '{1}', chr(10) ORDER BY n.name) FILTER ({0}), '- None')"
WITH = f"""{trees.WITH}, bodies AS (
  SELECT d.path, count(n.path) FILTER (NOT n.is_dir) AS files, count(n.path) FILTER (n.is_dir) AS dirs, string_agg(n.name, ',' ORDER BY n.name) FILTER (n.is_dir) AS dir_names,
    '# ' || d.path || chr(10) || chr(10) || 'Holds ' || d.path || '.' || chr(10) || chr(10) || '## Files' || chr(10) || {_BULLETS.format("NOT n.is_dir", "")} || chr(10) || chr(10) || '## Subdirectories' || chr(10) || {_BULLETS.format("n.is_dir", "/")}
    || CASE WHEN contains(d.path, '/') THEN '' ELSE chr(10) || chr(10) || '## Notes' || chr(10) || '- one' || chr(10) || '- two' END || chr(10) AS body
  FROM dirs d LEFT JOIN nodes n ON n.parent = d.path GROUP BY d.path
)"""
_FRONT = "'generated: ''2024-01-01T00:00:00Z''' || chr(10) || 'generator: g/1' || chr(10) || 'model: m' || chr(10) || 'content_hash: sha256:' || path || chr(10) || 'files: ' || files || chr(10) || 'dirs: ' || dirs || chr(10) || 'tokens_total: ' || length(path) * 10"
_ISSUES = """CASE length(path) % 5
  WHEN 1 THEN concat_ws('|', 'Manifest heading should be ''# ' || path || '''.', 'Manifest body is missing the directory purpose sentence.', 'Manifest body is missing the ''## Files'' section.', 'Manifest body is missing the ''## Subdirectories'' section.')
  WHEN 2 THEN 'Manifest body is missing the ''## Files'' section.'
  WHEN 3 THEN 'Frontmatter files=' || files + 1 || ' does not match filesystem files=' || files || '.'
  WHEN 4 THEN coalesce('Subdirectories entry is missing a trailing slash: ' || replace(dir_names, ',', '|Subdirectories entry is missing a trailing slash: '), '')
  ELSE '' END"""
SQL = {
    "manifest_render": f"{WITH} SELECT path, CASE WHEN length(path) % 7 = 3 THEN '' ELSE '---' || chr(10) END || {_FRONT} || chr(10) || '---' || chr(10) || body || chr(10) || '<!-- generated -->' || chr(10) AS text FROM bodies",
    "manifest_parse": f"{WITH} SELECT path, true AS ok, '2024-01-01T00:00:00Z' AS generated, 'm' AS model, 'sha256:' || path AS content_hash, files::VARCHAR AS files, dirs::VARCHAR AS dirs, (length(path) * 10)::VARCHAR AS tokens_total, body FROM bodies WHERE length(path) % 7 <> 3 UNION ALL SELECT path, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bodies WHERE length(path) % 7 = 3",
    "manifest_summary": f"{WITH} SELECT path, 'Holds ' || path || '.' AS summary FROM bodies",
    "purpose_notes": f"{WITH} SELECT path, 'Holds ' || path || '.' AS purpose, CASE WHEN contains(path, '/') THEN '' ELSE 'one,two' END AS notes FROM bodies",
    "subdir_summaries": f"{WITH} SELECT parent AS path, string_agg(name || ': Holds ' || path || '.', '|' ORDER BY name) AS children FROM bodies JOIN dirs USING (path) WHERE length(path) % 7 <> 3 AND parent IS NOT NULL GROUP BY parent",
    "verify_body": f"{WITH} SELECT path, {_ISSUES} AS issues FROM bodies",
    "json_summaries": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a ' || event_id || '|b' WHEN 1 THEN 'c ' || event_id END AS summaries FROM events",
}
