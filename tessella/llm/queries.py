"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

import importlib

#: module, function: each opN_<name> applies its operator to the whole intended table
_QUERIES = {
    "op1_hilbert": "hilbert",
    "op2_warc": "warc",
    "op3_suffixes": "suffixes",
    "op4_decontaminate": "decontaminate",
    "op5_quality": "quality",
    "op6_bpe": "bpe",
    "op7_interpolation": "lm",
    "op8_chat": "chat",
    "op9_secrets": "secrets",
    "op10_jaccard": "jaccard",
    "op11_records": "records",
    "op12_codes": "codes",
    "op13_divergence": "divergence",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
