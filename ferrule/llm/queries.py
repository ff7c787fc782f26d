"""Registered queries of this subpackage: `opN_<name>` on whole tables, and their SQL."""

from __future__ import annotations

from . import (
    op1_quality_rules,
    op2_quality_classifier,
    op3_toxicity,
    op4_mixing,
    op5_html_extraction,
    op6_jaccard_join,
    op7_packing,
    op8_warc,
    op9_exact_topk,
    op10_language_id,
)

QUERIES = {
    "op1_quality_rules": op1_quality_rules.query,
    "op2_quality_classifier": op2_quality_classifier.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_mixing": op4_mixing.query,
    "op5_html_extraction": op5_html_extraction.query,
    "op6_jaccard_join": op6_jaccard_join.query,
    "op7_packing": op7_packing.query,
    "op8_warc": op8_warc.query,
    "op9_exact_topk": op9_exact_topk.query,
    "op10_language_id": op10_language_id.query,
    "instruction_packing": op7_packing.instruction_query,
}

ORACLES = {
    "op1_quality_rules": op1_quality_rules.oracle(),
    "op6_jaccard_join": op6_jaccard_join.ORACLE,
    "op8_warc": op8_warc.ORACLE,
    "op9_exact_topk": op9_exact_topk.ORACLE,
}
