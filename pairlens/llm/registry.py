"""Queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from importlib import import_module

#: query name -> module; each module defines a function of the query's name.
QUERIES = {
    "op1_toxicity": "toxicity",
    "op2_topk": "topk",
    "op3_bpe": "bpe",
    "op4_warc": "warc",
    "op5_quality": "quality",
    "op6_neardup": "neardup",
    "op7_media": "media",
    "op8_html": "htmltext",
    "op9_secrets": "secrets",
    "op10_packing": "packing",
    "op11_runs": "runs",
    "op12_centroids": "centroids",
    "op13_simhash": "simhash",
}

#: modules with an ORACLE_SQL dict
SQL_MODULES: tuple[str, ...] = ("topk", "warc", "neardup", "secrets", "centroids")


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in SQL_MODULES:
        found |= import_module(f"{__package__}.{module}").ORACLE_SQL
    return found
