"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import covertree, langid, lmscore, minhash, packing, pieces, pii, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_lm_score": lmscore.op2_lm_score,
        "op3_embedding_near_dedup": covertree.op3_embedding_near_dedup,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_pii_surrogates": pii.op6_pii_surrogates,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": covertree.OP3_SQL,
        "op4_substring_dedup": substring.OP4_SQL,
        "op7_quality_rules": quality.OP7_SQL,
        "op9_minhash_near_dedup": minhash.OP9_SQL,
    }
