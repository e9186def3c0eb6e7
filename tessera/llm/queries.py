"""The registered corpus queries and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from tessera.llm import bpe, decontam, jaccard, knn, langid, lines, pii, shard, suffix, wordpiece

QUERIES = {
    "op1_voronoi_topk": knn.op1_voronoi_topk,
    "op2_bootstrapped_pii": pii.op2_bootstrapped_pii,
    "op3_template_decontamination": decontam.op3_template_decontamination,
    "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
    "op5_hypergeometric_shards": shard.op5_hypergeometric_shards,
    "op6_language_spans": langid.op6_language_spans,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_wordpiece_lengths": wordpiece.op8_wordpiece_lengths,
    "op9_bloom_line_dedup": lines.op9_bloom_line_dedup,
    "op10_multi_order_jaccard": jaccard.op10_multi_order_jaccard,
}

ORACLE_SQL = {
    "op1_voronoi_topk": knn.OP1_SQL,
    "op4_suffix_array_dedup": suffix.OP4_SQL,
    "op9_bloom_line_dedup": lines.OP9_SQL,
    "op10_multi_order_jaccard": jaccard.OP10_SQL,
}
