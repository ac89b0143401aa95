"""Directories against their stored manifests: fresh, stale or missing, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heartwood.functions import manifests
from heartwood.operators.tree import ROOT, closure

STATES = ("fresh", "stale", "missing")


def health(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status, tokens_total, error) of every directory.

    current: (path, hash); stored: (path, ok, content_hash, tokens_total). A
    manifest that doesn't parse (ok is false) is stale, with an error and no tokens.
    """
    s = stored.select("path", F.col("ok").alias("__ok"), F.col("content_hash").alias("__hash"), F.col("tokens_total").alias("__tokens"))
    status = F.when(F.col("__ok").isNull(), "missing").when(~F.col("__ok") | ~F.col("__hash").eqNullSafe(F.col("hash")), "stale").otherwise("fresh")
    return current.join(s, "path", "left").select("path", status.alias("status"), F.when(F.col("__ok"), F.col("__tokens")).alias("tokens_total"), F.when(~F.col("__ok"), F.lit("invalid front matter")).alias("error"))


def summary(h: DataFrame) -> DataFrame:
    return h.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def coverage(h: DataFrame) -> DataFrame:
    """Stale directories count as covered."""
    is_ = lambda s: F.col("status") == s
    return h.agg(F.count("*").alias("dirs"), F.count_if(~is_("missing")).alias("covered"), F.count_if(is_("missing")).alias("missing"), F.count_if(is_("stale")).alias("stale"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("long").alias("tokens"))


def stale_dirs(h: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Directories to regenerate; given changed files, only those above them."""
    due = h.where("status <> 'fresh'")
    return due if changed is None else due.join(closure(changed), "path", "left_semi")


def verify(h: DataFrame, fronts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(path, status): malformed, missing_fields, invalid_body, stale or missing; sound directories have no row.

    fronts: (path, the seven fields); bodies: (path, issues). A body is looked at only where everything before is in order.
    """
    lacking = fronts.select("path", F.size(manifests.missing_fields(F.struct(*manifests.REQUIRED))).alias("__lacking"))
    n = bodies.select("path", F.size("issues").alias("__issues"))
    all_ = h.join(lacking, "path", "left").join(n, "path", "left")
    kind = (
        F.when(F.col("error").isNotNull(), "malformed")
        .when(F.col("status") == "missing", "missing")
        .when(F.col("__lacking") > 0, "missing_fields")
        .when(F.col("status") == "stale", "stale")
        .when(F.col("__issues") > 0, "invalid_body")
    )
    return all_.select("path", kind.alias("status")).where("status IS NOT NULL")


def verify_summary(h: DataFrame, verified: DataFrame) -> DataFrame:
    """Counts by status of health, and of directories with anything to complain about."""
    n = verified.agg(F.count_distinct("path").alias("invalid"), F.count_if(F.col("status") == "invalid_body").alias("invalid_body"))
    return summary(h).withColumnRenamed("total", "dirs").crossJoin(n)


def budget_cutoff(dirs: DataFrame, budget: int) -> DataFrame:
    """(…, running, runs): deepest level first, a directory runs while the tokens before it are below the budget.

    The running sum is taken in two steps, within a level and over the levels'
    totals, so that no window holds the whole tree.
    """
    levels = dirs.groupBy("depth").agg(F.sum("tokens").alias("__level"))
    deeper = Window.partitionBy(F.lit(0)).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("depth", F.coalesce(F.sum("__level").over(deeper), F.lit(0)).alias("__deeper"))
    inside = Window.partitionBy("depth").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("__deeper")
    return dirs.join(F.broadcast(levels), "depth").withColumn("running", before.cast("long")).drop("__deeper").withColumn("runs", F.col("running") < budget)


def export(h: DataFrame, texts: DataFrame, mode: str = "all", manifest: str = manifests.MANIFEST) -> DataFrame:
    """(path, part) of what an export holds, to be joined by blank lines in order of path; mode: all, stale or missing."""
    if mode == "missing":
        shown = F.when(F.col("path") == ROOT, "./").otherwise(F.concat("path", F.lit("/")))
        return h.where("status = 'missing'").select("path", F.concat(F.lit("# "), shown, F.lit(" [MISSING]")).alias("part"))
    chosen = h.where("status = 'stale'" if mode == "stale" else "status <> 'missing'").select("path")
    rel = F.when(F.col("path") == ROOT, manifest).otherwise(F.concat("path", F.lit(f"/{manifest}")))
    return chosen.join(texts, "path").select("path", F.concat(F.lit("# "), rel, F.lit("\n\n"), "text").alias("part"))


def joined(parts: DataFrame, by: list[str], glue: str = "\n\n") -> DataFrame:
    """One text for each group, the parts in order of path."""
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "part"))), lambda x: x["part"]), glue).alias("content"))


def strategy(force: Column, has_manifests: Column, changed: Column) -> Column:
    """full without manifests or by force, smart if something changed, incremental else (changed is null without git)."""
    return F.when(force | ~has_manifests, "full").when(changed > 0, "smart").otherwise("incremental")
