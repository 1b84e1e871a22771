"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, langid, license_scan, line_dedup, mixing, near_dedup, token_counts, token_output, topk, toxicity

_QUERIES = {
    "op1_line_dedup": line_dedup,
    "op2_topk_search": topk,
    "op3_decontamination": decontaminate,
    "op4_token_counts": token_counts,
    "op5_toxicity": toxicity,
    "op6_mixing": mixing,
    "op7_token_output": token_output,
    "op8_near_dedup": near_dedup,
    "op9_license_scan": license_scan,
    "op10_language_id": langid,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if hasattr(module, "SQL")}
