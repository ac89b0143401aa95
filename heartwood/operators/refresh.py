"""A tree's manifests from end to end: scan, hash, compare, summarise, write; checks, exports and resets.

Directories are taken level by level, deepest first, one Spark job to a level:
the manifests that a level has written are what the next one reads of its
subdirectories. Within a level a directory is one group's work, and its manifest
is replaced as a whole, so a task that runs again leaves the same file. Manifests
are never part of a hash, so all hashes are worked out once, before the first
level. The driver gets counts, and the messages of directories that failed.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.config import Config
from heartwood.functions import costs, declarations, files, manifests
from heartwood.functions.errors import ConfirmationRequired
from heartwood.operators import health, ignore, models, tree
from heartwood.sources import git, store
from heartwood.sources.directory import DirectorySource, write_text

_DONE = "path string, files bigint, binary bigint, tokens bigint, fallbacks bigint, error string"


@dataclass
class Stats:
    dirs_processed: int = 0
    dirs_skipped: int = 0
    files_processed: int = 0
    files_binary: int = 0
    tokens_used: int = 0
    fallbacks: int = 0
    errors: list[str] = field(default_factory=list)
    budget_exhausted: bool = False
    strategy: str = ""

    def add(self, other: Stats) -> None:
        for name in ("dirs_processed", "dirs_skipped", "files_processed", "files_binary", "tokens_used"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        # a directory that failed and then succeeded is no error any more
        self.errors, self.budget_exhausted, self.fallbacks = other.errors, other.budget_exhausted, max(self.fallbacks, other.fallbacks)


def scan(spark: SparkSession, root: str, rules: str | None = None, max_depth: int | None = None, content: bool = True, only: str | None = None) -> DataFrame:
    """The tree below root without what is ignored; rules are the defaults and the tree's own unless they are given."""
    spark.dataSource.register(DirectorySource)
    reader = spark.read.format("directory").option("rules", ignore.load(root) if rules is None else rules).option("content", str(content).lower())
    for name, value in (("max_depth", max_depth), ("only", only)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(os.path.abspath(root))


def stored(spark: SparkSession, root: str, rules: str | None = None) -> DataFrame:
    """(path, mtime, text, m): every directory's manifest as it is on disk, parsed."""
    found = scan(spark, root, rules, only=manifests.MANIFEST).where("NOT is_dir")
    text = files.read_text(F.col("content"))
    return found.select(F.col("parent").alias("path"), "mtime", text.alias("text"), manifests.parse(F.coalesce(text, F.lit(""))).alias("m"))


def hashed(nodes: DataFrame) -> DataFrame:
    """(path, depth, hash) of every directory of a scan with contents. Loops count in the hashes above them and have no row: their manifest would be another directory's."""
    h = tree.merkle(nodes.drop("content"), nodes.where("NOT is_dir").select("path", files.file_hash(F.col("content")).alias("hash")))
    return h.join(nodes.where("is_loop").select("path"), "path", "left_anti")


def status(spark: SparkSession, root: str, rules: str | None = None) -> DataFrame:
    """(path, status, tokens_total, error) of every directory, in order of path."""
    front = stored(spark, root, rules).select("path", "m.ok", "m.content_hash", "m.tokens_total")
    return health.health(hashed(scan(spark, root, rules)), front).orderBy("path")


def has_manifests(spark: SparkSession, root: str) -> bool:
    """Whether there is any manifest below root, ignored directories included."""
    return not scan(spark, root, "", content=False, only=manifests.MANIFEST).where("NOT is_dir").isEmpty()


def check(spark: SparkSession, root: str, mode: str = "health", since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(directories, summary) of one mode: health, stats, verify or diff."""
    if mode == "diff":
        nodes = scan(spark, root, content=False).where("NOT is_dir")
        own = scan(spark, root, content=False, only=manifests.MANIFEST).where("NOT is_dir").select(F.col("parent").alias("path"), "mtime")
        found = git.manifest_diff(spark, root, nodes, own, since)
        return found, found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("modified", "new", "stale")])
    h = status(spark, root)
    if mode == "health":
        return h.select("path", "status"), health.summary(h)
    if mode == "stats":
        return h.select("path", F.when(F.col("status") == "fresh", "covered").otherwise(F.col("status")).alias("status"), F.col("tokens_total").alias("tokens")), health.coverage(h)
    if mode != "verify":
        raise ValueError(f"{mode} is no mode of check")
    own = stored(spark, root).where("m.ok")
    listing = tree.listing(scan(spark, root, content=False).where("NOT is_loop"))
    issues = manifests.validate(F.col("path"), F.col("m.body"), F.col("m.files"), F.col("m.dirs"), F.col("files"), F.col("dirs"))
    bodies = own.join(listing, "path").select("path", issues.alias("issues"))
    v = health.verify(h, own.select("path", *[F.col(f"m.{k}").alias(k) for k in manifests.REQUIRED]), bodies)
    return v.orderBy("path"), health.verify_summary(h, v)


def entries(nodes: DataFrame, max_chars: int = files.MAX_FILE_CHARS) -> DataFrame:
    """(parent, name, summary, content, language, metadata, tokens): what a model is told of each file; binary ones have a summary and no content."""
    binary = files.is_binary(F.col("content"))
    text = F.when(~binary, files.truncate(files.read_text(F.col("content")), max_chars))
    language = files.detect_language(F.col("name"))
    rows = nodes.where("NOT is_dir").select("parent", "name", F.when(binary, files.binary_info(F.col("name"), F.coalesce("size", F.lit(0)))).alias("summary"), text.alias("content"), language.alias("language"), files.read_text(F.col("content")).alias("__whole"))
    metadata = F.to_json(declarations.by_language(F.col("language"), F.coalesce("__whole", F.lit(""))))
    return rows.select("parent", "name", "summary", "content", "language", metadata.alias("metadata"), F.coalesce(files.token_estimate(F.col("content")), F.lit(0)).alias("tokens"))


def generate(due: DataFrame, told: DataFrame, below: DataFrame, root: str, model: models.Model, config: Config, now: str | None = None) -> DataFrame:
    """(path, files, binary, tokens, fallbacks, error): writes the manifests of ``due`` (path, hash, dirs) and says how that went.

    told: the entries; below: (path, summary) of directories that have a manifest.
    A directory's files are one group, and so one call of the model or as many as
    ``files_per_call`` makes of it.
    """
    name, per_call, stamp = models.chosen_model(config, model), config.files_per_call, now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    mine = due.join(told.withColumnRenamed("parent", "path"), "path", "left").withColumn("kind", F.lit(0))
    children = tree.children(below)
    kids = due.join(children, "path").select("path", "hash", "dirs", F.inline("children")).withColumn("kind", F.lit(1))
    rows = mine.unionByName(kids, allowMissingColumns=True)
    base = os.path.abspath(root)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        path = key[0]
        held = frame[(frame["kind"] == 0) & frame["name"].notna()].sort_values("name").to_dict("records")
        subdirs = frame[frame["kind"] == 1].sort_values("name")[["name", "summary"]].to_dict("records")
        texts = [r for r in held if r["content"] is not None]
        before, tokens = getattr(model, "fallbacks", 0), 0
        try:
            asked = [{"name": r["name"], "content": r["content"], "language": r["language"], "metadata": json.loads(r["metadata"] or "{}")} for r in texts]
            step = per_call or max(1, len(asked))
            answers = [a for k in range(0, len(asked), step) for a in model.files(path, asked[k : k + step])]
            if len(answers) != len(asked):
                raise ValueError(f"{len(asked)} summaries were expected and {len(answers)} came")
            for r, a in zip(texts, answers, strict=True):
                r["summary"] = " ".join(a.text.split())
            listed = [{"name": r["name"], "summary": r["summary"], "is_binary": r["content"] is None} for r in held]
            about = model.directory(path, listed, subdirs)
            tokens = sum(a.input_tokens + a.output_tokens for a in [*answers, about])
            purpose, notes = purpose_and_notes(about.text, path)
            front = {"generated": stamp, "generator": manifests.GENERATOR, "model": name, "content_hash": frame["hash"].iloc[0], "files": len(held), "dirs": int(frame["dirs"].iloc[0]), "tokens_total": int(sum(r["tokens"] for r in texts))}
            write_text(os.path.join(base, path, manifests.MANIFEST), rendered(path, front, purpose, listed, subdirs, notes))
            error = None
        except Exception as e:  # one directory's failure is a message, not the end of the run
            error = f"{path}: {e}"
        return pd.DataFrame([{"path": path, "files": len(held), "binary": len(held) - len(texts), "tokens": tokens, "fallbacks": getattr(model, "fallbacks", 0) - before, "error": error}])

    return rows.groupBy("path").applyInPandas(one, _DONE)


def purpose_and_notes(text: str, path: str) -> tuple[str, list[str]]:
    """``manifests.purpose_and_notes`` for one text in hand."""
    purpose, notes, inside = None, [], False
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("# "):
            continue
        head = line.startswith("## ")
        if purpose is None and not head:
            purpose = line
        elif head:
            inside = line == "## Notes"
        elif inside and line.startswith("- ") and line[2:].strip() not in ("", "None"):
            notes.append(line[2:].strip())
    return purpose or f"{path.rpartition('/')[2]} directory.", notes


def quoted(value: str) -> str:
    """``manifests.scalar`` for one text in hand; JSON's quotes read back in YAML."""
    return json.dumps(value)


def rendered(path: str, front: dict, purpose: str, listed: list[dict], subdirs: list[dict], notes: list[str]) -> str:
    head = "".join(f"{k}: {quoted(v) if isinstance(v, str) else v}\n" for k, v in front.items())
    bullets = lambda rows, slash: "\n".join(f"- **{r['name']}{slash}** — {r['summary']}" for r in rows) or "- None"
    extra = "\n\n## Notes\n" + "\n".join(f"- {n}" for n in notes) if notes else ""
    return f"---\n{head}---\n# {path}\n\n{purpose}\n\n## Files\n{bullets(listed, '')}\n\n## Subdirectories\n{bullets(subdirs, '/')}{extra}\n{manifests.FOOTER}"


def run(spark: SparkSession, root: str, config: Config, model: models.Model, incremental: bool, changed: list[str] | None = None, progress: Callable[[int, int, int, int], None] | None = None) -> Stats:
    """One pass over the levels; ``progress`` hears (depth, directories done, of how many, tokens used) after each.

    Incrementally, directories whose manifest is fresh are skipped; given changed files, only these' directories and those above are looked at.
    """
    nodes = scan(spark, root, max_depth=config.max_depth).persist()
    try:
        hashes = hashed(nodes).persist()
        front = stored(spark, root).select("path", "m.ok", "m.content_hash", "m.tokens_total")
        h = health.health(hashes, front).join(hashes, "path")
        if changed is not None:
            h = h.join(tree.closure(spark.createDataFrame([(p,) for p in changed], "path string")), "path", "left_semi")
        n_dirs = nodes.where("is_dir AND NOT is_loop AND path <> '.'").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("dirs"))
        looked = h.join(n_dirs, "path", "left").select("path", "depth", "hash", F.coalesce("dirs", F.lit(0)).alias("dirs"), ((F.col("status") != "fresh") if incremental else F.lit(True)).alias("due")).persist()
        levels = {r["depth"]: (r["n"], r["due"]) for r in looked.groupBy("depth").agg(F.count("*").alias("n"), F.count_if("due").alias("due")).collect()}
        told = entries(nodes, config.max_file_tokens)
        stats, total = Stats(), sum(n for n, _ in levels.values())
        for depth in sorted(levels, reverse=True):
            if config.token_budget is not None and stats.tokens_used >= config.token_budget:
                stats.dirs_skipped += sum(n for d, (n, _) in levels.items() if d <= depth)
                stats.budget_exhausted = True
                break
            n, due = levels[depth]
            stats.dirs_skipped += n - due
            if due:
                summary = manifests.summary_line(F.col("m.body"), tree.name_of(F.col("path")))
                below = stored(spark, root).where(F.col("m.ok") & (tree.depth_of(F.col("path")) == depth + 1)).select("path", summary.alias("summary"))
                level = looked.where(F.col("due") & (F.col("depth") == depth)).select("path", "hash", "dirs")
                done = generate(level, told, below, root, model, config)
                got = done.agg(F.count_if(F.col("error").isNull()).alias("dirs"), *[F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0)).alias(c) for c in ("files", "binary")], F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("fallbacks"), F.sort_array(F.collect_list("error")).alias("errors")).first()
                stats.dirs_processed += got["dirs"]
                stats.files_processed += got["files"]
                stats.files_binary += got["binary"]
                stats.tokens_used += got["tokens"]
                stats.fallbacks += got["fallbacks"]
                stats.errors += got["errors"]
            if progress is not None:
                progress(depth, stats.dirs_processed + stats.dirs_skipped, total, stats.tokens_used)
        return stats
    finally:
        nodes.unpersist()


def refresh(spark: SparkSession, root: str, config: Config, model: models.Model | None = None, force: bool = False, until_complete: bool = False, changed: list[str] | None = None, sleep: Callable[[float], None] = time.sleep, progress=None, home: str | None = None) -> Stats:
    """Brings a tree's manifests up to date and enters the run in the ledgers; one writer at a time.

    All directories by force or where there is no manifest yet; those above changed files where git names some; else whatever is stale.
    """
    model = model or models.create(config)
    if changed is None and not force:
        try:
            changed = git.changed_paths(root)
        except git.GitError:
            changed = None
    if force or not has_manifests(spark, root):
        strategy = "full"
    else:
        strategy = "smart" if changed else "incremental"
    total = Stats(strategy=strategy)
    limits = [x for x in (config.token_budget, config.max_tokens_per_run) if x is not None]
    config.token_budget = min(limits) if limits else None
    while True:
        with store.Lock(root, "refresh"):
            full = strategy == "full" and not total.dirs_processed
            stats = run(spark, root, config, model, not full, changed if strategy == "smart" else None, progress)
        total.add(stats)
        if not until_complete or not stats.dirs_processed or not (stats.budget_exhausted or stats.errors):
            break
        if config.max_usd_per_run is not None and cost(spark, total.tokens_used, config) >= config.max_usd_per_run:
            break
        sleep(config.resume_cooldown_seconds)
        strategy = total.strategy = "incremental"
    record(spark, root, config, total, home)
    return total


def cost(spark: SparkSession, tokens: int, config: Config) -> float:
    return spark.range(1).select(costs.estimate_cost(F.lit(tokens), F.lit(config.provider), F.lit(config.resolved_model()))).first()[0]


def record(spark: SparkSession, root: str, config: Config, stats: Stats, home: str | None = None) -> None:
    """Enters a run in the tree's ledger and the global one; a ledger that can't be written doesn't fail the run."""
    kinds = spark.createDataFrame([(e,) for e in stats.errors], "error string").groupBy(costs.error_type(F.col("error")).alias("k")).count()
    counts = {k: 0 for k in costs.ERROR_TYPES} | {r["k"]: r["count"] for r in (kinds.collect() if stats.errors else [])}
    usd = cost(spark, stats.tokens_used, config)
    row = {
        "ts": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "repo": os.path.abspath(root), "dirs_processed": stats.dirs_processed, "dirs_skipped": stats.dirs_skipped, "files_processed": stats.files_processed,
        "tokens_used": stats.tokens_used, "tokens_saved": 0, "est_cost_usd": usd, "cost_saved_usd": 0.0, "cache_hits": 0, "cache_misses": 0, "strategy": stats.strategy, "errors": len(stats.errors),
        "error_types": counts, "budget_exhausted": stats.budget_exhausted, "provider": config.provider, "model": config.resolved_model(),
    }
    try:
        store.append_runs(spark.createDataFrame([row], store.RUN).coalesce(1), store.ledger_folder(root, config.cache_path), store.global_folder(home))
    except Exception:
        pass


def export_context(spark: SparkSession, root: str, mode: str = "all", depth: int | None = None) -> str:
    """One text of all manifests that the mode chooses, in order of path."""
    h = status(spark, root)
    if depth is not None:
        h = h.where(tree.depth_of(F.col("path")) <= depth)
    parts = health.export(h, stored(spark, root).select("path", "text"), mode)
    return "".join(f"{r['part']}{chr(10) if mode == 'missing' else chr(10) * 2}" for r in parts.orderBy("path").toLocalIterator())


def reset(spark: SparkSession, root: str, yes: bool = False, dry_run: bool = False) -> list[str]:
    """Deletes every manifest below root, also in ignored directories, or only lists them."""
    found = scan(spark, root, "", content=False, only=manifests.MANIFEST).where("NOT is_dir").select("path")
    if not dry_run:
        if not yes:
            raise ConfirmationRequired("reset deletes every manifest of the tree")
        base = os.path.abspath(root)
        paths = sorted(r["path"] for r in found.collect())

        def delete(rows: Iterator) -> None:
            for r in rows:
                try:
                    os.unlink(os.path.join(base, r["path"]))
                except FileNotFoundError:  # a task that runs again
                    pass

        spark.createDataFrame([(p,) for p in paths], "path string").foreachPartition(delete) if paths else None
        return paths
    return sorted(r["path"] for r in found.collect())


def watch(spark: SparkSession, paths: DataFrame, root: str, config: Config, model: models.Model, told: Callable[[dict], None] = print, gap: str | None = None):
    """A streaming query over touched paths (``debounce.relevant``): each batch's changes are refreshed, and the tree's coverage is told.

    A batch that fails is told as well, and the stream goes on.
    """

    def batch(changed: DataFrame, number: int) -> None:
        try:
            stats = run(spark, root, config, model, True, sorted(r["path"] for r in changed.select("path").distinct().collect()))
            told({"batch": number, "dirs_processed": stats.dirs_processed, **health.coverage(status(spark, root)).first().asDict()})
        except Exception as e:
            told({"batch": number, "error": str(e)})

    out = paths.writeStream.foreachBatch(batch)
    return out.trigger(processingTime=gap or f"{int(config.watch_debounce_seconds * 1000)} milliseconds").start()
