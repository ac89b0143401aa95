"""A training-data pipeline over ``documents``: every stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. The last returns token ids, all others the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heartwood.llm import langid, mixing, pieces, pii, simhash
from heartwood.llm.common import ensure_checkpoint_dir, remove

STAGES = [
    ("language id", langid.stage),
    ("simhash near-dedup", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: No SQL: language models, hypergeometric draws and piece search have no SQL form. tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's rows written to the shared folder and read again; only the last stage's stay there."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
