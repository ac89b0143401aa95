"""File events: which ones count, and one firing for each burst.

``bursts`` is the deterministic event-time form: a path fires once when it has
been quiet for the gap, and events exactly a gap apart belong together. It
runs on batch and streaming DataFrames alike; on a stream a watermark bounds
the state, and a burst is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.manifests import MANIFEST
from heartwood.operators.ignore import ignored
from heartwood.operators.tree import name_of

GAP = "500 milliseconds"


def touched(events: DataFrame) -> DataFrame:
    """(path, ts, event_type, is_directory): a move touches both its ends."""
    both: Column = F.when(F.col("event_type") == "moved", F.array_distinct(F.array("src_path", "dest_path"))).otherwise(F.array("src_path"))
    return events.select(F.explode(F.array_compact(both)).alias("path"), "ts", "event_type", "is_directory")


def relevant(events: DataFrame, rules: list[str], manifest: str = MANIFEST) -> DataFrame:
    """What is touched, without manifests and ignored paths; directories count where they are the end of a move."""
    path, is_dir = F.col("path"), F.col("is_directory")
    fine = (name_of(path) != manifest) & ~ignored(path, is_dir, rules)
    return touched(events).where(fine & ((F.col("event_type") == "moved") | ~is_dir))


def bursts(events: DataFrame, key: str = "path", gap: str = GAP, late: str | None = None) -> DataFrame:
    """(key, first_ts, last_ts, events) of every burst."""
    source = events.withWatermark("ts", late) if late else events
    grouped = source.groupBy(key, F.session_window("ts", gap).alias("session"))
    return grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("session")
