"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontaminate, lm_score, merge_replay, minhash, oracle, quality_crf, quality_qda, run_index, sharding, token_counts, token_orc, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_virtual_slots": sharding.op1_virtual_slots,
    "op2_cross_entropy_difference": lm_score.op2_cross_entropy_difference,
    "op3_quality_qda": quality_qda.op3_quality_qda,
    "op4_toxicity_nb_linear": toxicity.op4_toxicity_nb_linear,
    "op5_minmax_hash": minhash.op5_minmax_hash,
    "op6_line_crf": quality_crf.op6_line_crf,
    "op7_run_index": run_index.op7_run_index,
    "op8_token_orc": token_orc.op8_token_orc,
    "op9_merge_replay": merge_replay.op9_merge_replay,
    "op10_qgram_bands": decontaminate.op10_qgram_bands,
    "op11_digest_cache": token_counts.op11_digest_cache,
    "op12_integer_codebooks": vector_codes.op12_integer_codebooks,
    "op13_prefix_trie": conversation_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_minmax_hash": oracle.NEAR_DUPLICATES,
    "op7_run_index": oracle.REPEATED_SPANS,
    "op12_integer_codebooks": oracle.VECTOR_CODES,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}
