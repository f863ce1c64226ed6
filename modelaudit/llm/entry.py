"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, function, SQL constant or None)
TABLE = {
    "op8_url_filter": ("url_filter", "op8_url_filter", None),
    "op10_exact_topk": ("topk", "op10_exact_topk", "SQL"),
    "op1_warc": ("warc", "op1_warc", "SQL"),
    "op2_pack": ("packing", "op2_pack", None),
    "op4_token_files": ("token_files", "op4_token_files", None),
    "op7_near_dup": ("near_dup", "op7_near_dup", None),
    "op6_line_dedup": ("line_dedup", "op6_line_dedup", "SQL"),
    "op9_decontaminate": ("decontam", "op9_decontaminate", "SQL"),
    "op5_quality": ("quality", "op5_quality", None),
    "op3_licenses": ("licenses", "op3_licenses", None),
    "op11_variants": ("variants", "op11_variants", "SQL"),
    "op12_hard_negatives": ("negatives", "op12_hard_negatives", "SQL"),
    "op13_pitman_yor": ("pitman_yor", "op13_pitman_yor", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"modelaudit.llm.{module}"), function) for name, (module, function, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"modelaudit.llm.{module}"), sql) for name, (module, _, sql) in TABLE.items() if sql}
