"""New versus accepted failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baseline_tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(fingerprint)``: first token of each line before any ``#``, each once."""
    t = F.regexp_extract(F.col(line), r"^\s*([^\s#]+)", 1)
    return lines.select(t.alias("fingerprint")).where("fingerprint <> ''").distinct()


def grouped(observed: DataFrame) -> DataFrame:
    """``(fingerprint, source, seq, rule_id, title)`` of rows of the same columns: each source of
    a failure once, at the place where it was first seen; rule and title are those of the
    failure's first row. One row per source, so no failure becomes one long row."""
    per = observed.groupBy("fingerprint", "source").agg(F.min("seq").alias("seq"))
    first = observed.groupBy("fingerprint").agg(F.min_by(F.struct("rule_id", "title"), "seq").alias("f"))
    return per.join(first, "fingerprint").select("fingerprint", "source", "seq", "f.rule_id", "f.title")


def listed(groups: DataFrame) -> DataFrame:
    """``(fingerprint, sources, rule_id, title)`` for documents: sources as lists in seen order."""
    return groups.groupBy("fingerprint", "rule_id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources")).select("fingerprint", "sources", "rule_id", "title")


def gate(observed: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new, known, stale)``: observed groups not in and in the baseline; baseline not observed."""
    g = grouped(observed)
    return g.join(baseline, "fingerprint", "left_anti"), g.join(baseline, "fingerprint", "left_semi"), baseline.join(observed.select("fingerprint").distinct(), "fingerprint", "left_anti")


def render_baseline(groups: DataFrame) -> list[str]:
    """Sorted lines ``fingerprint  # title`` of a baseline file; read row by row."""
    rows = [(r.fingerprint, (r.title or r.rule_id or "").split("\n")[0][:70]) for r in groups.select("fingerprint", "title", "rule_id").distinct().orderBy("fingerprint").toLocalIterator()]
    width = max((len(f) for f, _ in rows), default=0)
    return [f"{f.ljust(width)}  # {t}".rstrip() if t else f for f, t in rows]
