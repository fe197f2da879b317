"""The corpus operators' queries and, where SQL can say the same, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyquilt.llm import chat, classifier, decontaminate, mixing, quality, secrets, sharding, simhash, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_quality_classifier": classifier.op2_quality_classifier,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_simhash": simhash.op7_simhash,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_url_filters": urls.op10_url_filters,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op3_substring_dedup": substrings.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_secret_scans": secrets.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_url_filters": urls.ORACLE,
}
