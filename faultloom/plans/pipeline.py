"""From raw logs to explained failures: one lazy plan over all logs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions import text as X
from faultloom.operators import detect, rules, similarity

UNMATCHED = "unknown"


def _root(field: str) -> Column:
    return F.try_element_at("matches", F.lit(1))[field]


def analyze(units: DataFrame, pack: list[rules.Rule], raw: str = "text", around: int = 3, cap: int | None = None) -> DataFrame:
    """``units`` plus what is stored of an analysis: ``text`` (normalised), ``ecosystem``,
    ``matches`` (best first), ``rule_id``, ``matched``, ``fingerprint``, ``log_hash``, ``excerpt``
    and ``tokens``. The hash is that of the raw text; the fingerprint is made from the matched
    line, else from the lines that speak of errors; the excerpt is the matched line with its
    context, else the whole text. Nothing is shuffled. A null text stays unmatched. Texts are taken
    whole; ``cap`` cuts the middle of longer ones, as :func:`faultloom.functions.text.window_text`.
    """
    x = units.withColumnRenamed(raw, "__raw").withColumn("log_hash", X.log_hash("__raw"))
    x = x.withColumn("text", X.normalize(X.window_text("__raw", cap))).drop("__raw")
    x = x.withColumn("ecosystem", detect.ecosystem(F.col("text")))
    x = rules.match_rules(x, pack)
    x = x.withColumn("rule_id", F.coalesce(_root("rule_id"), F.lit(UNMATCHED))).withColumn("matched", F.size("matches") > 0)
    x = x.withColumn("__n", X.line_number_at("text", _root("position"))).withColumn("__lines", X.lines("text"))
    line = F.element_at("__lines", F.col("__n"))
    x = x.withColumn("__sig", F.when(F.col("matched"), X.utrim(line)).otherwise(F.array_join(X.error_like_lines("text"), "\n")))
    block = F.array_join(F.concat(X.context_before(F.col("__lines"), F.col("__n"), around), F.array(line), X.context_after(F.col("__lines"), F.col("__n"), around)), "\n")
    x = x.withColumn("fingerprint", X.fingerprint("rule_id", "__sig")).withColumn("excerpt", X.excerpt(F.when(F.col("matched"), block).otherwise(F.col("text"))))
    return x.withColumn("tokens", X.term_counts("text")).drop("__n", "__lines", "__sig")


def margins(matched: DataFrame, row_id: str = "id") -> DataFrame:
    """``(id, margin)``: by how much the best match beats the runner-up, where there are two."""
    m = lambda i: F.try_element_at("matches", F.lit(i))["score"]
    return matched.where(F.size("matches") > 1).select(F.col(row_id).alias("id"), (m(1) - m(2)).alias("margin"))


def similar_failures(analyses: DataFrame, history: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, id, score, rank)``: the k most similar rows of the history as it was before
    these analyses were stored; both hold ``id`` and ``tokens``."""
    side = lambda df: df.where(F.col("tokens").isNotNull()).select("id", F.col("tokens").alias("terms"))
    return similarity.tfidf_top(side(analyses), side(history), k)
