"""Queries of this subpackage and their DuckDB twins (only where SQL expresses the operator)."""
from __future__ import annotations

import importlib

MODULES = ["op1_caps", "op2_mixing", "op3_ordinal", "op4_html", "op5_jaccard", "op6_chat", "op7_quality", "op8_toxicity",
           "op9_warc", "op10_bpe", "op11_trie", "op12_grace", "op13_codes"]


def _modules():
    return {name: importlib.import_module(f"{__package__}.{name}") for name in MODULES}


def queries() -> dict:
    return {name: getattr(m, name) for name, m in _modules().items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules().values():
        out.update(getattr(m, "SQL", {}))
    return out
