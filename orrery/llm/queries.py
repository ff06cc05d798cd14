"""One query per operator, over its whole table.

None of them is expressible in SQL as a whole (hashed models, edit distances,
subword vocabularies, files), so there is no oracle SQL: tests/llm holds each
against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, chat, classifier, decontam, langid, licences, lm, neardup, quality, tokenfiles

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Query] = {
    "op1_language_id": _on(langid.op1, "documents"),
    "op2_decontamination": _on(decontam.op2, "documents", "benchmark"),
    "op3_near_duplicates": _on(neardup.op3, "documents"),
    "op4_licence_scan": _on(licences.op4, "documents"),
    "op5_bpe_round_trip": _on(bpe.op5, "documents"),
    "op6_token_files": _on(tokenfiles.op6, "documents"),
    "op7_quality_rules": _on(quality.op7, "documents"),
    "op8_lm_scoring": _on(lm.op8, "documents"),
    "op9_chat_format": _on(chat.op9, "conversations"),
    "op10_quality_classifier": _on(classifier.op10, "documents", "labels"),
}
ORACLE_SQL: dict[str, str] = {}
