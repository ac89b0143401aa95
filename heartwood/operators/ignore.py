"""Ignore rules: gitignore patterns as regular expressions that run in the JVM."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.operators.tree import ROOT, self_and_ancestors

#: Rules that hold for every tree, before a tree's own.
DEFAULTS = (
    "CONTEXT.md", ".git/", ".ctx-cache/", ".claude/", "tmp/", ".tmp/", "*.tmp", "*.tmp.*", "*.pyc", "*.pyc.*", "__pycache__/", "*.egg-info", "*.dist-info", "pip-wheel-metadata/", ".pytest_cache/", ".worktrees/", "node_modules/",
    "*.gdoc", "*.gsheet", "*.gslides", "*.gform", "*.gdraw", "*.gmap", "*.gsite",
)


#: A tree's own rules, in its root.
FILE = ".ctxignore"


def load(root: str) -> str:
    """The default rules and after them the tree's own."""
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            own = f.read()
    except OSError:
        own = ""
    return "\n".join([*DEFAULTS, own])


def rule_lines(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]


def to_regex(rule: str) -> tuple[str, bool]:
    """The pattern of paths (directories end with a slash), and whether the rule takes paths back in."""
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    rule = rule[1:] if rule.startswith("\\") else rule
    rule = re.sub(r"(?<!\\) +$", "", rule)
    only_dirs = rule.endswith("/")
    parts = rule.rstrip("/").lstrip("/").split("/")
    anchored = "/" in rule.rstrip("/")
    out = "^" if anchored else "^(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "[^/]*"
                while part[i + 1 : i + 2] == "*":
                    i += 1
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in part[i + 2 :]:
                end = part.index("]", i + 2)
                body = part[i + 1 : end].replace("\\", "\\\\")
                out += f"[{'^' + body[1:] if body[:1] in '!^' else body}]"
                i = end
            elif c == "\\" and i + 1 < len(part):
                i += 1
                out += re.escape(part[i])
            else:
                out += re.escape(c)
            i += 1
        out += "" if last else "/"
    return out + ("/.*$" if only_dirs else "(?:/.*)?$"), back


def ignored(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """Whether a path is ignored: an ancestor is, or the last rule that matches says so."""
    compiled = [to_regex(r) for r in rules]

    def own(p: Column) -> Column:
        out = F.lit(False)
        for pattern, back in compiled:
            out = F.when(F.rlike(p, F.lit(pattern)), F.lit(not back)).otherwise(out)
        return out

    above = F.slice(self_and_ancestors(path), 2, 1 << 20)
    pruned = F.exists(above, lambda a: (a != ROOT) & own(F.concat(a, F.lit("/"))))
    return (path != ROOT) & (pruned | own(F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)))


def keep(tree: DataFrame, rules: list[str]) -> DataFrame:
    return tree.where(~ignored(F.col("path"), F.col("is_dir"), rules))
