"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> module with a function ``query``
MODULES = {
    "op2_bpe_codec": "bpe_codec",
    "op5_token_counts": "token_counts",
    "op6_packing": "packing",
    "op7_token_files": "token_files",
    "op10_embedding_dups": "embedding_dups",
    "op4_toxicity": "toxicity",
    "op1_quality_rules": "quality_rules",
    "op3_quality_classifier": "perplexity",
    "op9_substring_dedup": "substring_dedup",
    "op8_jaccard_join": "jaccard_join",
    "op11_language_id": "language_id",
    "op12_collocations": "collocations",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"txlog.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = ((name, importlib.import_module(f"txlog.llm.{m}")) for name, m in MODULES.items())
    return {name: m.ORACLE_SQL for name, m in found if getattr(m, "ORACLE_SQL", None)}
