"""Trees keyed by path: directories, closures, ordered listings and bottom-up hashes.

Nodes have (path, parent, name, depth, is_dir); the root's path is '.', its
depth 0 and its parent null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.files import sentinel

ROOT = "."


def parent_of(path: Column) -> Column:
    return F.when(path == ROOT, None).when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(ROOT)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth_of(path: Column) -> Column:
    return F.when(path == ROOT, 0).otherwise(F.size(F.split(path, "/")))


def self_and_ancestors(path: Column) -> Column:
    """The path itself and all directories above it, the root last."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(path == ROOT, F.array(F.lit(ROOT))).otherwise(F.concat(up, F.array(F.lit(ROOT))))


def nodes(files: DataFrame) -> DataFrame:
    """Files, and the directories that their paths imply."""
    dirs = files.select(F.explode(self_and_ancestors(parent_of(F.col("path")))).alias("path")).distinct()
    both = files.select("path", F.lit(False).alias("is_dir")).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    return both.select("path", parent_of(F.col("path")).alias("parent"), name_of(F.col("path")).alias("name"), depth_of(F.col("path")).alias("depth"), "is_dir")


def within_depth(tree: DataFrame, depth: int | None) -> DataFrame:
    return tree if depth is None else tree.where(F.col("depth") <= depth)


def listing(tree: DataFrame) -> DataFrame:
    """(path, files, dirs): each directory's children by name, files and directories apart."""
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("is_dir") == kind, F.col("name"))))
    have = children.agg(pick(False).alias("files"), pick(True).alias("dirs"))
    none = F.array().cast("array<string>")
    return tree.where("is_dir").select("path").join(have, "path", "left").select("path", F.coalesce("files", none).alias("files"), F.coalesce("dirs", none).alias("dirs"))


def children(summaries: DataFrame) -> DataFrame:
    """(path, children): for each directory the (name, summary) of those directories in it that have a summary, by name."""
    below = summaries.where(F.col("path") != ROOT).select(parent_of(F.col("path")).alias("parent"), F.struct(name_of(F.col("path")).alias("name"), "summary").alias("c"))
    return below.groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list("c")).alias("children"))


def bottom_up(dirs: DataFrame) -> DataFrame:
    """Deepest first, by path within a depth."""
    return dirs.orderBy(F.desc("depth"), "path")


def closure(changed: DataFrame) -> DataFrame:
    """(path): the directories of changed files and everything above them, once each."""
    return changed.select(F.explode(self_and_ancestors(parent_of(F.col("path")))).alias("path")).distinct()


def merkle(tree: DataFrame, file_hashes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, depth, hash) of every directory: SHA-256 over 'name:hash' lines of its children by name.

    One grouping for each level, deepest first; a file's hash comes from
    ``file_hashes`` (path, hash). An empty directory has the hash of nothing;
    one that can't be listed, or contains itself, a hash of its own kind (where
    the tree has the columns unlisted and is_loop). The deepest level is asked
    of the tree unless ``max_depth`` gives it. Ignored children must have been
    left out of the tree.
    """
    if max_depth is None:
        max_depth = tree.where("is_dir").agg(F.max("depth")).first()[0] or 0
    leaves = tree.where("NOT is_dir").join(file_hashes, "path").select("parent", "name", "hash", "depth")
    odd = [F.when(F.col(c), sentinel(label)) for c, label in (("is_loop", "loop"), ("unlisted", "error")) if c in tree.columns]
    below = None
    levels = []
    for depth in range(max_depth, -1, -1):
        dirs = tree.where(F.col("is_dir") & (F.col("depth") == depth)).select("path", "parent", "name", F.coalesce(*odd, F.lit(None).cast("string")).alias("odd"))
        children = leaves.where(F.col("depth") == depth + 1).drop("depth")
        children = children if below is None else children.unionByName(below)
        line = F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda c: F.concat(c["name"], F.lit(":"), c["hash"], F.lit("\n")))
        summed = children.groupBy(F.col("parent").alias("path")).agg(F.array_join(line, "").alias("lines"))
        own = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256))
        hashed = dirs.join(summed, "path", "left").withColumn("hash", F.coalesce("odd", own))
        levels.append(hashed.select("path", F.lit(depth).alias("depth"), "hash"))
        below = hashed.select("parent", "name", "hash")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
