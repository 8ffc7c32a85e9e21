"""The registered corpus queries, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from palimpsest.llm import decontamination, katz, line_dedup, mixing, quality, sharding, simhash, substring_dedup, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_mixing": mixing.op2_mixing,
        "op3_sharding": sharding.op3_sharding,
        "op4_quality": quality.op4_quality,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_katz": katz.op7_katz,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
    }
