"""Summaries of files by a pluggable model: cache, batches, and answers put back in place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from heartwood.functions.costs import output_budget

Summarizer = Callable[[str, list[dict]], list[str]]


def fake(directory: str, files: list[dict]) -> list[str]:
    """The deterministic model of tests and of the queries."""
    return [f"Summary for {f['name']}" for f in files]


def cache_key(model: Column, name: Column, language: Column, content: Column) -> Column:
    """Content-addressed: depends on model, name, language and content, not on the path."""
    entry = F.to_json(F.struct(content.alias("content"), F.coalesce(language, F.lit("")).alias("language"), name.alias("name")))
    return F.sha2(F.concat(model, F.lit(":"), entry).cast("binary"), 256)


def first_claims(requests: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """One request for each key, the first: the others share its answer, so no key is asked for twice."""
    cols = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("__r")).select(key, "__r.*")


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached summary; hit says whether there was one."""
    known = cache.select("key", F.col("summary").alias("summary"))
    return requests.join(known, "key", "left").withColumn("hit", F.col("summary").isNotNull())


def hit_counts(looked_up: DataFrame) -> DataFrame:
    """(hits, misses) of a look-up."""
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def evict(cache: DataFrame, keep: int) -> DataFrame:
    """The newest entries by first insertion; a key written again keeps its place and takes the new summary."""
    merged = cache.groupBy("key").agg(F.max_by("summary", "seq").alias("summary"), F.min("seq").alias("seq"))
    return merged.orderBy(F.desc("seq"), "key").limit(keep)


def batches(files: DataFrame, per_call: int, directory: str = "directory") -> DataFrame:
    """Numbers each directory's files and its calls of up to per_call files."""
    row = F.row_number().over(Window.partitionBy(directory).orderBy("name"))
    return files.withColumn("position", row).withColumn("batch", ((F.col("position") - 1) / per_call).cast("int"))


def usage(batched: DataFrame, directory: str = "directory") -> DataFrame:
    """A call's tokens stand on its first row, 0 on the rest."""
    call = Window.partitionBy(directory, "batch")
    first = F.col("position") == F.min("position").over(call)
    spent = lambda c: F.when(first, c).otherwise(0)
    return batched.withColumn("input_tokens", spent(F.sum("tokens").over(call)).cast("long")).withColumn("output_tokens", spent(output_budget(F.count("*").over(call))).cast("long"))


def summarize(files: DataFrame, model: Summarizer = fake, directory: str = "directory") -> DataFrame:
    """(directory, name, summary): a directory's files lie in one partition and go to the model in one call for each Arrow batch that they fill.

    A model that fails or gives a wrong number of answers is asked file by file; a file that it still fails on has a null summary.
    """

    def single(d: str, item: dict) -> str | None:
        try:
            return model(d, [item])[0]
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby(directory, sort=False, dropna=False):
                items = part.drop(columns=[directory]).to_dict("records")
                try:
                    answers = model(d, items)
                except Exception:
                    answers = []
                if len(answers) != len(items):
                    answers = [single(d, x) for x in items]
                yield pd.DataFrame({directory: part[directory], "name": part["name"], "summary": answers})

    return files.repartition(directory).sortWithinPartitions(directory, "name").mapInPandas(run, f"{directory} string, name string, summary string")


def zipped(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers put back by position: (directory, position, name, summary); binary files keep the summary they came with."""
    a = answers.select("directory", F.col("position").alias("text_position"), F.col("text"))
    nth = F.sum((~F.col("is_binary")).cast("int")).over(Window.partitionBy("directory").orderBy("position"))
    placed = entries.withColumn("text_position", F.when(~F.col("is_binary"), nth))
    return placed.join(a, ["directory", "text_position"], "left").select("directory", "position", "name", F.when(F.col("is_binary"), F.col("summary")).otherwise(F.col("text")).alias("summary"))


def find_json_array(text: str | None) -> list[str] | None:
    """The texts of the first JSON array in an answer: strings, or objects with a summary; None where there is none."""
    stripped = (text or "").strip()
    decoder = json.JSONDecoder()
    try:
        found = json.loads(stripped)
    except ValueError:
        found = None
        at = stripped.find("[")
        while at >= 0 and found is None:
            try:
                found = decoder.raw_decode(stripped, at)[0]
            except ValueError:
                at = stripped.find("[", at + 1)
    if not isinstance(found, list):
        return None
    out = [x if isinstance(x, str) else x.get("summary") if isinstance(x, dict) else None for x in found]
    return [" ".join(x.split()) for x in out] if all(isinstance(x, str) for x in out) else None


@F.pandas_udf(ArrayType(StringType()))
def json_summaries(text: pd.Series) -> pd.Series:
    return text.map(find_json_array, na_action=None)
