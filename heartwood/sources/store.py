"""Files that runs leave behind: JSON objects, the ledger, the cache of summaries, and the lock of a tree's one writer."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.operators import ledger
from heartwood.sources.directory import write_text

FOLDER = ".ctx-cache"
RUN = (
    "ts string, repo string, dirs_processed bigint, dirs_skipped bigint, files_processed bigint, tokens_used bigint, tokens_saved bigint, est_cost_usd double, cost_saved_usd double,"
    " cache_hits bigint, cache_misses bigint, strategy string, errors bigint, error_types struct<transient:bigint,timeout:bigint,rate_limit:bigint,budget:bigint,other:bigint>, budget_exhausted boolean, provider string, model string"
)
#: A lock older than this many seconds belongs to nobody.
LOCK_SECONDS = 3600.0


def load_json(path: str, default: dict) -> dict:
    """The object in a file; the default if it is missing, can't be read, is no JSON or no object."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return default
    return found if isinstance(found, dict) else default


def save_json(path: str, data: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write_text(path, json.dumps(data, indent=2) + "\n")


def parse_json(text: F.Column, schema: str, default: F.Column) -> F.Column:
    """``load_json`` for a column of texts: the default for nulls and for whatever isn't an object of that schema."""
    whole = F.trim(text)
    return F.coalesce(F.when(F.startswith(whole, F.lit("{")), F.from_json(whole, schema, {"mode": "PERMISSIVE"})), default)


def texts_only(text: F.Column) -> F.Column:
    """The entries of a JSON object whose values are texts; an empty map for anything else."""
    raw = F.from_json(F.when(F.startswith(F.trim(text), F.lit("{")), text), "map<string,variant>")
    strings = F.map_filter(raw, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(strings, lambda k, v: F.try_variant_get(v, "$", "string")), F.create_map().cast("map<string,string>"))


def cache_file(root: str, cache_path: str | None) -> str | None:
    """Where summaries are cached: by default inside the tree; an empty setting switches the cache off."""
    if cache_path == "":
        return None
    return cache_path or os.path.join(root, FOLDER, "llm_cache.json")


def ledger_folder(root: str, cache_path: str | None) -> str | None:
    """Where a tree's runs are kept, beside its cache; None if that is switched off."""
    cache = cache_file(root, cache_path)
    return None if cache is None else os.path.join(os.path.dirname(cache), "runs")


def global_folder(home: str | None = None) -> str:
    """Where all trees' runs are kept."""
    return os.path.join(home or os.path.expanduser("~"), FOLDER, "runs")


def append_runs(runs: DataFrame, *folders: str | None) -> None:
    """Appends runs to the ledgers; folders that are None are switched off. Files are added, none is written again, so two writers don't lose a run."""
    schema = runs.sparkSession.createDataFrame([], RUN).schema
    full = runs.select(*[(F.col(f.name) if f.name in runs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    for folder in folders:
        if folder is not None:
            full.write.mode("append").parquet(folder)


def read_runs(spark: SparkSession, folder: str | None) -> DataFrame:
    """A ledger's runs with ``seq``, their order by time; empty where there is none."""
    if folder is None or not os.path.isdir(folder):
        runs = spark.createDataFrame([], RUN)
    else:
        runs = spark.read.schema(RUN).parquet(folder)
    return runs.withColumn("seq", F.struct("ts", F.xxhash64(*[c for c, t in runs.dtypes])))


def global_board(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each repository's totals, and everything's."""
    runs = read_runs(spark, folder)
    return ledger.per_repo(runs), ledger.totals(runs)


class LockHeld(RuntimeError):
    """Another live process writes to the tree."""


class Lock:
    """One writer for a tree, by a file that names its process; a dead process' or a very old lock is taken over."""

    def __init__(self, root: str, command: str):
        self.path, self.command = os.path.join(root, FOLDER, "lock"), command

    def holder(self) -> dict[str, str]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return dict(line.strip().split("=", 1) for line in f if "=" in line)
        except OSError:
            return {}

    @staticmethod
    def _stale(held: dict[str, str]) -> bool:
        try:
            pid, since = int(held["pid"]), float(held["timestamp"])
        except (KeyError, ValueError):
            return True
        if time.time() - since > LOCK_SECONDS or pid <= 0:
            return True
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def __enter__(self) -> Lock:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        text = f"pid={os.getpid()}\ntimestamp={time.time()}\ncommand={self.command}\n"
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                held = self.holder()
                if not self._stale(held):
                    raise LockHeld(f"{held.get('command')} (process {held.get('pid')}) is writing to this tree") from None
                try:
                    os.unlink(self.path)
                except FileNotFoundError:
                    pass
                continue
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
            return self
        raise LockHeld("another process took the lock")

    def __exit__(self, *_: object) -> None:
        try:
            os.unlink(self.path)
        except FileNotFoundError:
            pass
