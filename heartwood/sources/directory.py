"""A directory tree on a shared disk as a Spark data source, and a writer of manifests that survives repeated tasks.

Spark's own file sources skip names that begin with a dot or an underscore and
have no rows for directories, so a tree needs a source of its own. The driver
lists directories from the root down, level by level, only until there are
``SPREAD`` of them; each of these is an input partition and is walked by an
executor. Ignored directories are never entered.

Rows: (path, parent, name, depth, is_dir, size, mtime, is_loop, unlisted,
content). An unreadable file has null content; a directory that can't be listed
is ``unlisted`` and one that contains itself by a link ``is_loop``: both are
rows without children.

Options: path; max_depth (directories at that depth have no children); rules
(ignore rules, one on each line); content ("false" leaves the column out, and
no file is opened); only (a file name: no other files have rows, and rules
don't hide this one).
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heartwood.operators.ignore import rule_lines, to_regex

SCHEMA = "path string, parent string, name string, depth int, is_dir boolean, size bigint, mtime timestamp, is_loop boolean, unlisted boolean"
SPREAD = 64


class Rules:
    """Ignore rules on the executors: the last rule that matches decides. Parents are asked first by whoever walks down."""

    def __init__(self, text: str):
        self.rules = [(re.compile(p), back) for p, back in map(to_regex, rule_lines(text))]

    def ignores(self, rel: str, is_dir: bool) -> bool:
        path = f"{rel}/" if is_dir else rel
        return next((not back for p, back in reversed(self.rules) if p.search(path)), False)


class _Reader(DataSourceReader):
    def __init__(self, root: str, max_depth: int | None, rules: str, content: bool, only: str | None):
        self.root, self.max_depth, self.rules, self.content, self.only = root, max_depth, rules, content, only

    def _children(self, rel: str, rules: Rules) -> tuple[list[str], list[str], bool, bool]:
        """Files and directories below one directory that aren't ignored, by name; whether it is a loop, and whether it can't be listed."""
        full = os.path.join(self.root, rel)
        if rel != ".":
            above = [self.root, *(os.path.join(self.root, *rel.split("/")[:k]) for k in range(1, rel.count("/") + 1))]
            if os.path.realpath(full) in set(map(os.path.realpath, above)):
                return [], [], True, False
        if self.max_depth is not None and (0 if rel == "." else rel.count("/") + 1) >= self.max_depth:
            return [], [], False, False
        try:
            names = sorted(os.listdir(full))
        except OSError:
            return [], [], False, True
        files, dirs = [], []
        for name in names:
            child = name if rel == "." else f"{rel}/{name}"
            is_dir = os.path.isdir(os.path.join(self.root, child))
            if is_dir:
                if not rules.ignores(child, True):
                    dirs.append(child)
            elif name == self.only if self.only else not rules.ignores(child, False):
                files.append(child)
        return files, dirs, False, False

    def partitions(self) -> list[InputPartition]:
        rules = Rules(self.rules)
        shallow, deep = [], ["."]
        while deep and len(deep) < SPREAD:
            below = [d for rel in deep for d in self._children(rel, rules)[1]]
            shallow, deep = shallow + deep, below
        step = max(1, -(-len(shallow) // SPREAD))
        return [*(InputPartition(("one", shallow[k : k + step])) for k in range(0, len(shallow), step)), *(InputPartition(("all", [d])) for d in deep)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kind, todo = partition.value
        rules = Rules(self.rules)
        todo = list(todo)
        while todo:
            rel = todo.pop()
            files, dirs, loop, unlisted = self._children(rel, rules)
            yield self._row(rel, True, loop, unlisted)
            for child in files:
                yield self._row(child, False, False, False)
            if kind == "all":
                todo += reversed(dirs)

    def _row(self, rel: str, is_dir: bool, loop: bool, unlisted: bool) -> tuple:
        full = os.path.join(self.root, rel)
        parent = None if rel == "." else os.path.dirname(rel) or "."
        depth = 0 if rel == "." else rel.count("/") + 1
        try:
            stat = os.stat(full)
            size, mtime = None if is_dir else stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC)
        except OSError:
            size, mtime = None, None
        row = (rel, parent, os.path.basename(rel), depth, is_dir, size, mtime, loop, unlisted)
        if not self.content:
            return row
        content = None
        if not is_dir:
            try:
                with open(full, "rb") as f:
                    content = f.read()
            except OSError:
                pass
        return (*row, content)


class DirectorySource(DataSource):
    """``spark.dataSource.register(DirectorySource)``, then ``spark.read.format("directory").option("max_depth", 3).load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "directory"

    def _content(self) -> bool:
        return str(self.options.get("content", "true")).lower() == "true"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self._content() else "")

    def reader(self, schema) -> DataSourceReader:
        depth = self.options.get("max_depth")
        return _Reader(self.options["path"], None if depth is None else int(depth), self.options.get("rules", ""), self._content(), self.options.get("only"))


def write_text(path: str, text: str) -> None:
    """The file whole or not at all: who writes it again replaces it with the same."""
    folder, name = os.path.split(path)
    fd, temporary = tempfile.mkstemp(prefix=f".{name}.", suffix=".tmp", dir=folder or ".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_manifests(texts: DataFrame, root: str, manifest: str = "CONTEXT.md") -> None:
    """Writes (path, text) below root."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            write_text(os.path.join(root, r["path"], manifest), r["text"])

    texts.select("path", "text").foreachPartition(write)
