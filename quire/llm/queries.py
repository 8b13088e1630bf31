"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import audio, dedup, language, mixing, pages, phrases, sequences, sharding, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": pages.op1_html_extraction,
        "op2_mixing": mixing.op2_mixing,
        "op3_language_id": language.op3_language_id,
        "op4_benchmark_decontamination": phrases.op4_benchmark_decontamination,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_url_filters": urls.op6_url_filters,
        "op7_minhash_near_dedup": dedup.op7_minhash_near_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_token_sequences": sequences.op9_token_sequences,
        "op10_media_columns": audio.op10_media_columns,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL, "op4_benchmark_decontamination": phrases.OP4_SQL, "op6_url_filters": urls.OP6_SQL, "op7_minhash_near_dedup": dedup.OP7_SQL,
        "op8_sharding": sharding.OP8_SQL, "op10_media_columns": audio.OP10_SQL,
    }
