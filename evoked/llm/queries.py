"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_chat_format": "chat_format",
    "op2_page_diff": "page_diff",
    "op3_bpe_automaton": "bpe_automaton",
    "op4_url_tree": "url_tree",
    "op5_lang_fusion": "lang_fusion",
    "op6_simhash_variants": "simhash",
    "op7_line_dedup": "line_dedup",
    "op8_toxic_crf": "toxic_crf",
    "op9_adaptive_quality": "adaptive_quality",
    "op10_positional_index": "positional_index",
}


def _module(name: str):
    return importlib.import_module(f"evoked.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
