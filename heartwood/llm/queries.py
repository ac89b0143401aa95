"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them if the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heartwood.llm import ego, html, langid, license_scan, mixing, permutation, pieces, pii, simhash, substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.query,
        "op2_sentencepiece": pieces.query,
        "op3_embedding_dedup": ego.query,
        "op4_nearest_neighbors": permutation.query,
        "op5_mixing": mixing.query,
        "op6_simhash_dedup": simhash.query,
        "op7_pii": pii.query,
        "op8_html_extraction": html.query,
        "op9_license_scan": license_scan.query,
        "op10_language_id": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.SQL,
        "op3_embedding_dedup": ego.SQL,
        "op6_simhash_dedup": simhash.SQL,
        "op9_license_scan": license_scan.SQL,
    }
