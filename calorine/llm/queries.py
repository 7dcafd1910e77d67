"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from calorine.llm import chat, decontaminate, embeddings, licenses, mixing, passages, pii, quality, setjoin, tokens

QUERIES = {
    "op1_surrogates": pii.op1_surrogates,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_ngram_jaccard_join": setjoin.op5_ngram_jaccard_join,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_token_output": tokens.op8_token_output,
    "op10_substring_dedup": passages.op10_substring_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
}
ORACLES = {
    "op2_embedding_near_dedup": embeddings.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op4_license_scan": licenses.oracle(),
    "op6_chat_formatting": chat.ORACLE,
}
