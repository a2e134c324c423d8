"""Queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import byte_bpe, chat_format, collocations, decontaminate, html_extract, importance, language_id, media_audio, near_dedup, secret_scan, substring_dedup, token_count, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.query,
    "op4_language_id": language_id.query,
    "op9_near_dedup": near_dedup.query,
    "op10_html_extract": html_extract.query,
    "op7_chat_format": chat_format.query,
    "op3_media_audio": media_audio.query,
    "op6_byte_bpe": byte_bpe.query,
    "op8_token_count": token_count.query,
    "op2_substring_dedup": substring_dedup.query,
    "op5_decontamination": decontaminate.query,
    "op11_importance_resampling": importance.query,
    "op12_word_bpe": word_bpe.query,
    "op13_collocations": collocations.query,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_chat_format": chat_format.SQL,
    "op11_importance_resampling": importance.SQL,
    "op13_collocations": collocations.SQL,
}
