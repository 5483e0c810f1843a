"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, divergence, jaccard, language, licenses, packing, passages, quality, sharding, suffix_dedup, token_counts, urls, whitening

_MODULES = {
    "op1_suffix_decontamination": decontaminate,
    "op2_line_frequency": quality,
    "op3_jaccard_join": jaccard,
    "op4_spfhp_packing": packing,
    "op5_histogram_sort": sharding,
    "op6_patience_licenses": licenses,
    "op7_compact_windows": passages,
    "op8_association_rules": urls,
    "op9_language_ppm": language,
    "op10_column_suffixes": suffix_dedup,
    "op11_radix_divergence": divergence,
    "op12_block_lanczos": whitening,
    "op13_two_tier_tokens": token_counts,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
