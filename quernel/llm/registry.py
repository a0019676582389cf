"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_license,
    op2_packing,
    op3_secrets,
    op4_neardup,
    op5_embeddings,
    op6_decontaminate,
    op7_toxicity,
    op8_html,
    op9_quality,
    op10_language,
)

MODULES = (op1_license, op2_packing, op3_secrets, op4_neardup, op5_embeddings, op6_decontaminate, op7_toxicity, op8_html, op9_quality, op10_language)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {m.__name__.rpartition(".")[2]: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for m in MODULES for name in [m.__name__.rpartition(".")[2]] if hasattr(m, "SQL")}
