"""The training-data queries and their SQL, added to the driver contract when this package is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockledger.llm import conversations, decontaminate, exact_dedup, language, licenses, mixing, quality_model, quality_rules, simhash, tokens, url_filter, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_quality": quality_model.op3_quality,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_language": language.op5_language,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
