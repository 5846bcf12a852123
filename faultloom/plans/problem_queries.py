"""Queries of the general problems 1 and 6 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultloom.operators.gap_scan import reappearances
from faultloom.operators.log_entries import log_entries
from faultloom.session import table

SILENCE_SECONDS = 21 * 24 * 3600


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(table(spark, sf_dir, "analyses"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reappearances(table(spark, sf_dir, "analyses"), {"fingerprint": "fingerprint", "rule_id": "rule_id"}, "analyzed_at", "id", SILENCE_SECONDS)


QUERIES = {"p1_found": p1_found, "p6_found": p6_found}

ORACLE = {
    "p6_found": """
        WITH k AS (
            SELECT 'fingerprint' AS key_kind, fingerprint AS key_value, id, analyzed_at FROM analyses
            UNION ALL SELECT 'rule_id', rule_id, id, analyzed_at FROM analyses
        ), g AS (
            SELECT *, lag(analyzed_at) OVER (PARTITION BY key_kind, key_value ORDER BY analyzed_at, id) AS before FROM k
            WHERE key_value IS NOT NULL AND analyzed_at IS NOT NULL
        )
        SELECT key_kind, key_value, id FROM g WHERE epoch_us(analyzed_at) - epoch_us(before) > 21 * 86400::BIGINT * 1000000
    """,
}
