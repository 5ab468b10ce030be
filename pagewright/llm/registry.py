"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

import importlib

#: module -> query function; a module's ``SQL``, if any, is the query's oracle.
_MODULES = {
    "fingerprint": "op1_lz_fingerprint",
    "packing": "op2_packing",
    "token_files": "op3_token_files",
    "html_text": "op4_html_text",
    "suffix_dedup": "op5_suffix_dedup",
    "transducer": "op6_bpe_transducer",
    "minhash": "op7_minhash",
    "quality": "op8_quality_rules",
    "sharding": "op9_sharding",
    "masked_lm": "op10_masked_lm",
    "url_rules": "op11_url_rules",
    "centroids": "op12_hamerly",
    "filter_audit": "op13_filter_audit",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"pagewright.llm.{module}"), name) for module, name in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"pagewright.llm.{module}"), "SQL", None) for module, name in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
