"""Aggregates over the history. Every one is a partial aggregation before its shuffle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.text import test_name, utrim


def _late():
    """Seen after its first resolution."""
    return F.coalesce(F.max("analyzed_at") > F.min("resolved_at"), F.lit(False))


def totals(h: DataFrame) -> DataFrame:
    resolved = F.count_if(F.coalesce(F.col("status") == "resolved", F.lit(False)))
    return h.agg(F.count("*").alias("total"), (F.count("*") - resolved).alias("open"), resolved.alias("resolved"), F.count_if(~F.col("matched")).alias("unmatched"))


def by_ecosystem(h: DataFrame) -> DataFrame:
    key = F.when(F.coalesce(utrim("ecosystem"), F.lit("")) == "", "unknown").otherwise(F.col("ecosystem"))
    return h.groupBy(key.alias("ecosystem")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ecosystem")


def fingerprint_stats(h: DataFrame) -> DataFrame:
    """Flaky: seen again after its first resolution. The rule is that of the newest matched row."""
    return h.groupBy("fingerprint").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.max("analyzed_at").alias("last_seen"),
        _late().alias("flaky"),
        F.max_by("rule_id", F.struct("matched", "id")).alias("rule_id"),
    )


def top_failures(h: DataFrame, top: int = 10) -> DataFrame:
    return fingerprint_stats(h).orderBy(F.desc("n"), F.desc("last_seen"), "fingerprint").limit(max(1, top))


def flaky_failures(h: DataFrame) -> DataFrame:
    return fingerprint_stats(h).where("flaky").orderBy(F.desc("last_seen"), "fingerprint")


def recurrence_rate(h: DataFrame) -> DataFrame:
    g = h.groupBy("fingerprint").count()
    return g.agg(F.coalesce(F.count_if(F.col("count") > 1) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("recurrence_rate"), F.count("*").alias("fingerprints"))


def time_to_resolve(h: DataFrame) -> DataFrame:
    """Mean seconds over rows resolved not before their analysis, and their number."""
    sane = h.where("resolved_at IS NOT NULL AND resolved_at >= analyzed_at")
    return sane.agg(F.floor(F.avg(F.unix_micros("resolved_at") - F.unix_micros("analyzed_at"))).alias("mean_us"), F.count("*").alias("n"))


def daily_counts(h: DataFrame, today: date, days: int = 30) -> DataFrame:
    """One row for each of the last ``days`` UTC days, days without failures included."""
    spark = h.sparkSession
    if days <= 0:
        return spark.createDataFrame([], "day date, n long")
    end = F.lit(today).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = h.groupBy(F.to_date("analyzed_at").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("day")


def test_rows(h: DataFrame) -> DataFrame:
    return h.withColumn("test", test_name("source")).where("test IS NOT NULL")


def test_stats(h: DataFrame, key: str = "test") -> DataFrame:
    rows = h if key in h.columns else test_rows(h)
    return rows.groupBy(key).agg(
        F.count("*").alias("failures"), F.count_distinct(F.to_date("analyzed_at")).alias("days"), F.count_if(F.col("status") == "open").alias("open_count"), F.max("analyzed_at").alias("last_seen"), _late().alias("flaky")
    )


def top_tests(h: DataFrame, top: int = 20) -> DataFrame:
    return test_stats(h).orderBy(F.desc("failures"), F.desc("flaky"), F.desc("last_seen"), "test").limit(max(1, top))


def test_totals(h: DataFrame) -> DataFrame:
    return test_stats(h).agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.count("*").alias("tests"), F.count_if("flaky").alias("flaky"))
