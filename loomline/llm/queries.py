"""The registered queries of this subpackage and their oracle SQL."""

from loomline.llm import bpe_tree, byte_bpe, chroma, divergence, mixing, quality_rules, recurrent_lm, sentence_spans, simhash, spelling, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_bpe_tree": bpe_tree.op2_bpe_tree,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_chroma": chroma.op8_chroma,
    "op9_sentence_spans": sentence_spans.op9_sentence_spans,
    "op10_recurrent_lm": recurrent_lm.op10_recurrent_lm,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
