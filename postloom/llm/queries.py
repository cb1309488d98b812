"""The queries of the llm subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_canonical", "q_terms", "q_leakage", "q_mixing", "q_sentences", "q_languages", "q_content", "q_personal"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _mod = import_module(f"postloom.llm.{_m}")
    QUERIES |= _mod.QUERIES
    SQL |= _mod.SQL
