"""The queries of this subpackage, as registered by __spark_entry__.py."""

from __future__ import annotations

from tarn.llm import op1_ngram_lm, op2_toxicity, op3_decontaminate, op4_exact_topk, op5_simhash_bktree, op6_line_dedup, op7_url_rules, op8_hilbert_shards, op9_sentencepiece, op10_language, op11_source_divergence, op12_periodic_runs, op13_embedding_hnsw

MODULES = [op1_ngram_lm, op2_toxicity, op3_decontaminate, op4_exact_topk, op5_simhash_bktree, op6_line_dedup, op7_url_rules, op8_hilbert_shards, op9_sentencepiece, op10_language, op11_source_divergence, op12_periodic_runs, op13_embedding_hnsw]


def name_of(module) -> str:
    return module.__name__.rpartition(".")[2]


QUERIES = {name_of(m): getattr(m, name_of(m)) for m in MODULES}
ORACLES = {name_of(m): m.ORACLE for m in MODULES if hasattr(m, "ORACLE")}
