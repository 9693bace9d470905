"""Queries of this subpackage, by name."""

from __future__ import annotations

from deltaloom.llm.decontaminate import op10_benchmark_decontamination
from deltaloom.llm.html_text import op7_html_extraction
from deltaloom.llm.language import op8_language_id
from deltaloom.llm.merkle import op11_merkle_manifest
from deltaloom.llm.minhash import op12_minhash_near_dedup
from deltaloom.llm.packing import op3_best_fit_packing
from deltaloom.llm.pii import op2_pii
from deltaloom.llm.quality import op1_quality_classifier
from deltaloom.llm.quality_rules import op6_quality_rules
from deltaloom.llm.simhash import op9_simhash_near_dedup
from deltaloom.llm.substrings import op5_substring_dedup
from deltaloom.llm.toxicity import op4_toxicity
from deltaloom.llm.trie import op13_conversation_trie

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}
