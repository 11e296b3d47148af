"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, id_files, language, line_dedup, packing, quality, simhash, token_counts, toxicity, url_filter, vector_codes, vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_packing": packing.op1_packing,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_vector_dedup": vector_dedup.op3_vector_dedup,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language": language.op7_language,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_id_files": id_files.op13_id_files,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op3_vector_dedup": vector_dedup.ORACLE,
        "op10_decontaminate": decontaminate.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
    }
