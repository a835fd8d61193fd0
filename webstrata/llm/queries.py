"""Registered queries of the training-data operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import decontamination, fingerprints, html_extract, importance_resampling, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, periodic_runs, quality, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_language_id": language_id.op5_language_id,
        "op6_mixing": mixing.op6_mixing,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_warc": warc.op10_warc,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_importance_resampling": importance_resampling.op12_importance_resampling,
        "op13_quality_rules": quality.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op7_license_scan": license_scan.OP7_SQL,
        "op10_warc": warc.OP10_SQL,
        "op12_importance_resampling": importance_resampling.OP12_SQL,
    }
