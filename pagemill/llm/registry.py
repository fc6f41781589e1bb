"""Queries of this subpackage."""

from __future__ import annotations

import importlib

#: Query -> module with its query(), and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_kmeans_tree": "ann",
    "op2_tool_call_linking": "tools",
    "op3_boosted_candidates": "pii",
    "op4_log_template_tree": "lines",
    "op5_byte_bpe": "bpe",
    "op6_quality_rules": "quality",
    "op7_count_vector_rtree": "jaccard",
    "op8_harmonic_packing": "packing",
    "op9_warc_index_merge": "warc",
    "op10_context_tree_weighting": "ctw",
}


def _load(module: str):
    return importlib.import_module(f"{__package__}.{module}")


def queries() -> dict:
    return {name: _load(module).query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(_load(module), "ORACLE_SQL", None))}
