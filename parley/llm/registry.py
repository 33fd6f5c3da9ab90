"""Queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

import importlib

#: query -> (module, attribute with its SQL or None); the function is named like the query
_TABLE = {
    "op10_passages": ("passages", None),
    "op7_langid": ("langid", None),
    "op5_topk": ("kdtree", "OP5_SQL"),
    "op1_chat": ("chat", "OP1_SQL"),
    "op2_quality_rules": ("rules", "OP2_SQL"),
    "op3_minhash": ("minhash", "OP3_SQL"),
    "op4_pii": ("pii", None),
    "op6_bpe": ("bpe", None),
    "op8_sharding": ("hilbert", None),
    "op9_mixing": ("mixing", "OP9_SQL"),
    "op11_repair": ("repair", "OP11_SQL"),
    "op12_token_counts": ("tokencount", None),
    "op13_vector_codes": ("codes", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"parley.llm.{module}"), name) for name, (module, _) in _TABLE.items()}


def oracle_sql() -> dict:
    return {name: getattr(importlib.import_module(f"parley.llm.{module}"), sql) for name, (module, sql) in _TABLE.items() if sql}
