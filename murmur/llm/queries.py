"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

# Query, module of this subpackage.
MODULES = {
    "op1_quality_model": "quality_model",
    "op2_suffixes": "suffixes",
    "op3_licenses": "licenses",
    "op4_simhash": "simhash",
    "op5_bpe": "bpe",
    "op6_hmm": "hmm",
    "op7_mixing": "mixing",
    "op8_topk": "topk",
    "op9_quality_rules": "quality_rules",
    "op10_secrets": "secrets",
    "op11_runs": "periods",
    "op12_warc": "warc",
    "op13_infill": "infill",
}
# Modules whose query SQL can express hold it as SQL.
WITH_SQL = ("op2_suffixes", "op8_topk", "op11_runs", "op12_warc", "op13_infill")


def queries() -> dict:
    return {name: getattr(import_module(f"murmur.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"murmur.llm.{MODULES[name]}").SQL for name in WITH_SQL}
