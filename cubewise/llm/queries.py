"""Registered queries of this package: ``name -> (spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from . import (
    alignment,
    chat,
    decontaminate,
    fim,
    fingerprints,
    language_id,
    licenses,
    near_dedup,
    packing,
    passages,
    quality,
    token_counts,
    vector_search,
)

QUERIES = {
    "op1_pack": packing.op1,
    "op2_licenses": licenses.op2,
    "op3_language": language_id.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_vector_search": vector_search.op6,
    "op7_passages": passages.op7,
    "op8_token_counts": token_counts.op8,
    "op9_chat": chat.op9,
    "op10_quality": quality.op10,
    "op11_alignment": alignment.op11,
    "op12_fingerprints": fingerprints.op12,
    "op13_fill_in_middle": fim.op13,
}

ORACLE_SQL = {
    "op9_chat": chat.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
