"""Registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from lorespark.llm import op1_suffix_dedup, op10_hmm, op11_periodic_runs, op12_vector_codes, op13_minhash, op2_toxicity, op3_topk, op4_language, op5_packing, op6_substring_dedup, op7_simhash, op8_mixing, op9_quality

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_topk": op3_topk.query,
    "op4_language": op4_language.query,
    "op5_packing": op5_packing.query,
    "op6_substring_dedup": op6_substring_dedup.query,
    "op7_simhash": op7_simhash.query,
    "op8_mixing": op8_mixing.query,
    "op9_quality": op9_quality.query,
    "op10_hmm": op10_hmm.query,
    "op11_periodic_runs": op11_periodic_runs.query,
    "op12_vector_codes": op12_vector_codes.query,
    "op13_minhash": op13_minhash.query,
}
ORACLES: dict[str, str] = {
    "op3_topk": op3_topk.SQL,
    "op6_substring_dedup": op6_substring_dedup.SQL,
    "op9_quality": op9_quality.SQL,
    "op12_vector_codes": op12_vector_codes.SQL,
}
