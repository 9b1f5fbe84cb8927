"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from subdiv.llm.decontaminate import op2_decontamination
from subdiv.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from subdiv.llm.html_extract import op4_html_extraction
from subdiv.llm.language_id import op7_language_id
from subdiv.llm.license_scan import op6_license_scan
from subdiv.llm.near_vectors import OP11_SQL, op11_near_vectors
from subdiv.llm.ngram_join import op3_ngram_join
from subdiv.llm.packing import op8_best_fit_packing
from subdiv.llm.phrases import OP13_SQL, op13_phrases
from subdiv.llm.quality_model import op5_quality_model
from subdiv.llm.quality_rules import op10_quality_rules
from subdiv.llm.toxicity import op9_toxicity
from subdiv.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_join": op3_ngram_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_model": op5_quality_model,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_near_vectors": op11_near_vectors,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_phrases": op13_phrases,
}

ORACLES = {"op1_url_filter": OP1_SQL, "op11_near_vectors": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_phrases": OP13_SQL}
