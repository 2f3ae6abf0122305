"""The subpackage's queries and their DuckDB equivalents."""

from __future__ import annotations

from tessera.llm import media, minhash, mixing, packing, quality, substring, toxicity, urlfilter, vectors, warc

MODULES = {
    "op1_quality_cotraining": quality,
    "op2_embedding_near_dedup": vectors,
    "op3_mix_sources": mixing,
    "op4_toxicity": toxicity,
    "op5_substring_dedup": substring,
    "op6_media_columns": media,
    "op7_minhash_near_dedup": minhash,
    "op8_warc_archives": warc,
    "op9_url_filter": urlfilter,
    "op10_best_fit_packing": packing,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()} | {"embedding_links_derived": vectors.embedding_links_derived}


def oracle_sql() -> dict:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)} | {"embedding_links_derived": vectors.DERIVED_ORACLE}
