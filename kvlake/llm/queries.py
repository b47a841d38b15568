"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, mixing, pii, quality, simhash, substr, suffix, tokenstore, topk

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_pii": pii.op2_pii,
        "op3_simhash": simhash.op3_simhash,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_token_store": tokenstore.op5_token_store,
        "op6_suffix_dedup": suffix.op6_suffix_dedup,
        "op7_language_id": langid.op7_language_id,
        "op8_substring_dedup": substr.op8_substring_dedup,
        "op9_top_k": topk.op9_top_k,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": suffix.SQL, "op8_substring_dedup": substr.SQL, "op9_top_k": topk.SQL, "op10_mix_sources": mixing.SQL}
