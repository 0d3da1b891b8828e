"""Registered queries of the operators: name -> (query over (spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from gradewell.llm import clustering, collocations, decontaminate, huffman, jaccard, langid, lm, packing, pii, quality, repeats, toxicity, warc

QUERIES = {
    "op1_noisy_or_toxicity": (toxicity.op1_noisy_or_toxicity, None),
    "op2_qgram_lemma": (decontaminate.op2_qgram_lemma, None),
    "op3_ftrl_language": (langid.op3_ftrl_language, None),
    "op4_quality_divergence": (quality.op4_quality_divergence, quality.oracle),
    "op5_canonical_huffman": (huffman.op5_canonical_huffman, None),
    "op6_interval_tree_repeats": (repeats.op6_interval_tree_repeats, None),
    "op7_hierarchical_packing": (packing.op7_hierarchical_packing, None),
    "op8_deobfuscated_pii": (pii.op8_deobfuscated_pii, None),
    "op9_prefix_tree_join": (jaccard.op9_prefix_tree_join, None),
    "op10_elias_fano_lm": (lm.op10_elias_fano_lm, None),
    "op11_bisector_tournament": (clustering.op11_bisector_tournament, clustering.oracle),
    "op12_gzip_normaliser": (warc.op12_gzip_normaliser, warc.oracle),
    "op13_stripes": (collocations.op13_stripes, collocations.oracle),
}


def queries():
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql():
    return {k: v[1]() for k, v in QUERIES.items() if v[1] is not None}
