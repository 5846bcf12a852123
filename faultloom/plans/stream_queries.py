"""Streaming queries and report parsing over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.session import Scratch, table
from faultloom.sources import reports
from faultloom.streaming import events as E


def _stream(s, d) -> DataFrame:
    return s.readStream.schema(table(s, d, "analyses").schema).parquet(f"{d}/analyses*.parquet")


def stream_dedup(s, d):
    x = _stream(s, d).select(F.when(F.col("matched"), "matched").otherwise("unmatched").alias("event"), "fingerprint", F.col("analyzed_at").alias("at"), "id")
    return E.run_to_table(E.deduplicated(x, window_seconds=86_400, delay="60 days"), Scratch(s)).select("id", "event", "fingerprint")


def stream_daily(s, d):
    return E.daily_counts(_stream(s, d), Scratch(s))


def stream_recurrence(s, d):
    return E.recurrence(_stream(s, d), Scratch(s))


def report_failures(s, d):
    """Every failing test written as a report of its own format and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("&#10;"))
    attr = lambda n, c: F.coalesce(F.concat(F.lit(f' {n}="'), esc(F.col(c)), F.lit('"')), F.lit(""))
    t = table(s, d, "test_failures").where("name IS NOT NULL").select("source", "name", "classname", "message", "details", "assembly").distinct()
    body = F.concat(F.lit("<testsuite"), attr("name", "assembly"), F.lit("><testcase"), attr("name", "name"), attr("classname", "classname"), F.lit("><failure"), attr("message", "message"), F.lit(">"), F.coalesce(esc(F.col("details")), F.lit("")), F.lit("</failure></testcase></testsuite>"))
    files = t.select(F.concat("source", F.lit(".xml")).alias("source"), body.alias("content"))
    return reports.test_failures(files).select("source", "name", "classname", "message", "assembly", "full_name")


QUERIES = {"stream_dedup": stream_dedup, "stream_daily": stream_daily, "stream_recurrence": stream_recurrence, "report_failures": report_failures}
ORACLE = {
    "stream_daily": "SELECT analyzed_at::DATE AS day, count(*)::BIGINT AS n FROM analyses WHERE analyzed_at IS NOT NULL GROUP BY 1",
    "stream_recurrence": "SELECT id, CASE WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY id) > 1 THEN 'recurrence' ELSE 'new-failure' END AS event FROM analyses",
    "stream_dedup": """
        WITH RECURSIVE k AS (
            SELECT id, CASE WHEN matched THEN 'matched' ELSE 'unmatched' END AS event, fingerprint, epoch_us(analyzed_at) AS t,
                row_number() OVER (PARTITION BY matched, fingerprint ORDER BY analyzed_at, id) AS n FROM analyses
        ), r AS (
            SELECT id, event, fingerprint, t AS last, n, true AS sent FROM k WHERE n = 1
            UNION ALL SELECT k.id, k.event, k.fingerprint, CASE WHEN k.t - r.last >= 86400000000 THEN k.t ELSE r.last END, k.n, k.t - r.last >= 86400000000
            FROM r JOIN k ON k.event = r.event AND k.fingerprint = r.fingerprint AND k.n = r.n + 1
        ) SELECT id, event, fingerprint FROM r WHERE sent
    """,
    "report_failures": r"""
        SELECT source || '.xml' AS source, name, classname, coalesce(message, trim(coalesce(details, ''))) AS message,
            nullif(regexp_replace(regexp_extract(trim(assembly), '([^/\\]*)$', 1), '(?i)\.(dll|exe)$', ''), '') AS assembly,
            CASE WHEN trim(coalesce(classname, '')) = '' THEN name ELSE classname || '.' || name END AS full_name
        FROM (SELECT DISTINCT source, name, classname, message, details, assembly FROM test_failures WHERE name IS NOT NULL)
    """,
}
