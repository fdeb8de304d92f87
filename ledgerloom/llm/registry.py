"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, html_text, language_id, merkle, near_dedup, piece_codec, token_counts, token_files, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_document_fingerprints": merkle.op6_document_fingerprints,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_sentencepiece": piece_codec.op9_sentencepiece,
    "op10_token_binary": token_files.op10_token_binary,
}

#: The others learn a model, parse markup or run a tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_document_fingerprints": merkle.ORACLE_SQL,
    "op7_url_filters": url_filters.ORACLE_SQL,
    "op8_minhash_near_dedup": near_dedup.ORACLE_SQL,
}
