"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, fingerprints, html_extraction, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_byte_bpe": bpe_codec.op9_byte_bpe,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_url_filters": url_filters.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
}
