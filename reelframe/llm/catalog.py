"""Queries of this subpackage by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import codes, decontam, htmltext, language, mixing, neardup, quality, runs, secrets, sharding, substring, tokencount, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_secrets": secrets.op2_secrets,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_language": language.op5_language,
        "op6_sharding": sharding.op6_sharding,
        "op7_minhash": neardup.op7_minhash,
        "op8_tokens": tokencount.op8_tokens,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_substring": substring.op10_substring,
        "op11_runs": runs.op11_runs,
        "op12_html": htmltext.op12_html,
        "op13_codes": codes.op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.OP2_SQL, "op10_substring": substring.OP10_SQL, "op13_codes": codes.OP13_SQL}
