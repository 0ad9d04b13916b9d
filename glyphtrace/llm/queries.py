"""The corpus operators' queries, by the names under which they are registered."""

from __future__ import annotations

from importlib import import_module

#: query name: module of this subpackage, whose query() it is; ORACLE is its SQL where SQL can express it.
MODULES = {
    "op1_shingle_join": "shingle_join",
    "op2_substring_dedup": "substring_dedup",
    "op3_quality_classifier": "quality",
    "op4_nearest_neighbours": "nearest",
    "op5_best_fit_packing": "packing",
    "op6_source_mixing": "mixing",
    "op7_near_vectors": "near_vectors",
    "op8_repeated_bytes": "suffix_dedup",
    "op9_licences": "licences",
    "op10_language_model": "language_model",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
