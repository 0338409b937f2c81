"""The registered queries of this subpackage and, where SQL can express them,
their equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mizan.llm import bpe, fingerprint, html_text, jaccard, mixing, pseudolikelihood, quality, sharding, spans, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality": quality.op2_quality,
        "op3_sharding": sharding.op3_sharding,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_pseudolikelihood": pseudolikelihood.op5_pseudolikelihood,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_spans": spans.op7_spans,
        "op8_mixing": mixing.op8_mixing,
        "op9_bpe": bpe.op9_bpe,
        "op10_html": html_text.op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard": jaccard.ORACLE_SQL}
