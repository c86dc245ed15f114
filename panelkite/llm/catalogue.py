"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkite.llm import lines, mixing, neardup, ngrams, pieces, pii, quality, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": neardup.op1_neardup,
        "op2_pii": pii.op2_pii,
        "op3_ngrams": ngrams.op3_ngrams,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_mixing": mixing.op5_mixing,
        "op6_lines": lines.op6_lines,
        "op7_sharding": sharding.op7_sharding,
        "op8_topk": topk.op8_topk,
        "op9_quality": quality.op9_quality,
        "op10_pieces": pieces.op10_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngrams": ngrams.SQL, "op5_mixing": mixing.SQL, "op6_lines": lines.SQL, "op8_topk": topk.SQL}
