"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from corpusmill.llm import decontaminate, license_scan, line_dedup, log_replay, merkle, near_dedup, packing, pii, quality_classifier, quality_rules, repeats, token_counts, url_filter
from corpusmill.llm.common import table


def queries():
    return {
        "op1_decontaminate": lambda spark, d: decontaminate.op1_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op10_pii": lambda spark, d: pii.op10_pii(table(spark, d, "documents")),
        "op11_repeated_passages": lambda spark, d: repeats.op11_repeated_passages(table(spark, d, "documents")),
        "op12_log_replay": lambda spark, d: log_replay.op12_log_replay(table(spark, d, "documents"), table(spark, d, "labels")),
        "op13_merkle_manifest": lambda spark, d: merkle.op13_merkle_manifest(table(spark, d, "documents")),
        "op2_best_fit_packing": lambda spark, d: packing.op2_best_fit_packing(table(spark, d, "documents")),
        "op3_quality_rules": lambda spark, d: quality_rules.op3_quality_rules(table(spark, d, "documents")),
        "op4_near_dedup": lambda spark, d: near_dedup.op4_near_dedup(table(spark, d, "documents")),
        "op5_license_scan": lambda spark, d: license_scan.op5_license_scan(table(spark, d, "documents")),
        "op6_line_dedup": lambda spark, d: line_dedup.op6_line_dedup(table(spark, d, "documents")),
        "op7_url_filter": lambda spark, d: url_filter.op7_url_filter(table(spark, d, "pages")),
        "op8_quality_classifier": lambda spark, d: quality_classifier.op8_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_token_counts": lambda spark, d: token_counts.op9_token_counts(table(spark, d, "documents"), table(spark, d, "labels")),
    }


def oracle_sql():
    return {"op1_decontaminate": decontaminate.ORACLE, "op11_repeated_passages": repeats.ORACLE, "op12_log_replay": log_replay.ORACLE, "op13_merkle_manifest": merkle.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op4_near_dedup": near_dedup.ORACLE, "op5_license_scan": license_scan.ORACLE, "op6_line_dedup": line_dedup.ORACLE}
