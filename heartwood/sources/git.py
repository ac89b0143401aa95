"""Changed files of a git working tree as tables. The driver asks git; what it answers is a list of names."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions.manifests import MANIFEST
from heartwood.operators.tree import parent_of


class GitError(RuntimeError):
    """git is missing, or a command failed; ``unborn`` says that the branch has no commit yet."""

    def __init__(self, message: str):
        super().__init__(message)
        self.unborn = any(x in message for x in ("ambiguous argument 'HEAD'", "bad revision 'HEAD'", "unknown revision", "does not have any commits", "Needed a single revision"))


def names(root: str, *command: str) -> set[str]:
    """The lines of a git command's output; quoting of odd names is switched off."""
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", *command], cwd=root, capture_output=True, text=True, check=True)
    except FileNotFoundError as e:
        raise GitError("git isn't installed") from e
    except subprocess.CalledProcessError as e:
        raise GitError(f"git failed: {e.stderr.strip()}") from e
    return {line.strip() for line in done.stdout.splitlines() if line.strip()}


def changed_paths(root: str) -> list[str]:
    """Unstaged and staged changes since the last commit; before the first commit also files that git doesn't know yet."""
    staged = ("diff", "--name-only", "--cached")
    try:
        found = names(root, "diff", "--name-only", "HEAD") | names(root, *staged)
    except GitError as e:
        if not e.unborn:
            raise
        found = names(root, "diff", "--name-only") | names(root, *staged) | names(root, "ls-files", "--others", "--exclude-standard")
    return sorted(found)


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of ``changed_paths``."""
    return spark.createDataFrame([(p,) for p in changed_paths(root)], "path string")


def manifest_diff(spark: SparkSession, root: str, files: DataFrame, manifests: DataFrame, since: str | None = None, manifest: str = MANIFEST) -> DataFrame:
    """(path, status): manifests that changed since a commit (modified) or that git doesn't know (new).

    Without git, and without ``since``, directories whose manifest is older than a file beside it (stale).
    files: (path, mtime) of all files but manifests; manifests: (path, mtime) with the directory's path.
    """
    where = ("--", f"*/{manifest}", manifest)
    try:
        modified, new = names(root, "diff", "--name-only", since or "HEAD", *where), names(root, "ls-files", "--others", "--exclude-standard", *where)
    except GitError as e:
        if since is not None:
            raise ValueError("a commit to compare with needs git and a working tree of its") from e
        return older_than_siblings(files, manifests).withColumn("status", F.lit("stale"))
    return spark.createDataFrame([*((p, "modified") for p in sorted(modified - new)), *((p, "new") for p in sorted(new))], "path string, status string")


def older_than_siblings(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path) of directories whose manifest is older than the newest file beside it; subdirectories don't count."""
    newest = files.groupBy(parent_of(F.col("path")).alias("path")).agg(F.max("mtime").alias("newest"))
    return manifests.join(newest, "path").where("newest > mtime").select("path")
