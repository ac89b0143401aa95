"""Queries over file events; ``events`` stands in for them, a user for a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.sources.tables import table
from heartwood.streaming import debounce

GAP = "1 hour"


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = debounce.bursts(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", GAP)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return b.select("user_id", stamp("first_ts"), stamp("last_ts"), "events")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.when(F.col("event_id") % 6 == 0, "CONTEXT.md").when(F.col("event_id") % 6 == 1, "x.tmp").otherwise("f.txt"))
    kind = F.when(F.col("event_type") == "signup", "moved").otherwise("modified")
    e = table(spark, sf_dir, "events").select("event_id", "ts", path.alias("src_path"), kind.alias("event_type"), (F.col("event_id") % 5 == 0).alias("is_directory"))
    return e.withColumn("dest_path", F.when(F.col("event_type") == "moved", F.concat("src_path", F.lit(".new"))))


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("path").agg(F.count("*").alias("n"))


QUERIES = {
    "debounce": bursts,
    "move_explode": lambda s, d: counted(debounce.touched(_events(s, d))),
    "event_filter": lambda s, d: counted(debounce.relevant(_events(s, d), ["*.tmp"])),
}
_EVENTS = "WITH e AS (SELECT event_id, 'd' || (user_id % 7) || '/' || CASE event_id % 6 WHEN 0 THEN 'CONTEXT.md' WHEN 1 THEN 'x.tmp' ELSE 'f.txt' END AS src, event_type = 'signup' AS moved FROM events)"
_BOTH = "SELECT path, count(*) AS n FROM (SELECT src AS path FROM {0} UNION ALL SELECT src || '.new' FROM {0} WHERE moved) GROUP BY path"
SQL = {
    "debounce": """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS events FROM runs GROUP BY user_id, k""",
    "move_explode": f"{_EVENTS} {_BOTH.format('e')}",
    "event_filter": f"""{_EVENTS}, ends AS (SELECT src AS path, moved, event_id % 5 = 0 AS folder FROM e UNION ALL SELECT src || '.new', moved, event_id % 5 = 0 FROM e WHERE moved)
SELECT path, count(*) AS n FROM ends WHERE split_part(path, '/', 2) <> 'CONTEXT.md' AND NOT ends_with(path, '.tmp') AND (moved OR NOT folder) GROUP BY path""",
}
