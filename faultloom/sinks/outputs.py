"""Result documents. JSON forms are Columns; whole documents are text made from small results."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions.text import annotation_text, first_line, quality_severity, report_path, sarif_level


def analysis_json(source: str = "source") -> Column:
    """One analysis as JSON, from columns of :func:`faultloom.operators.rules.match_rules`; nulls
    are left out and confidence is rounded half-even to four places."""
    one = lambda m: F.struct(
        m["rule_id"].alias("ruleId"), m["title"].alias("title"), m["category"].alias("category"), F.bround(m["score"], 4).alias("confidence"), m["docs"].alias("docs"), m["severity"].alias("severity"),
        F.when(F.size(m["captures"]) > 0, m["captures"]).alias("captures"), F.when(m["occurrences"] > 1, m["occurrences"]).alias("occurrenceCount"),
    )
    return F.to_json(F.struct(F.col(source).alias("source"), F.lower("ecosystem").alias("ecosystem"), (F.size("matches") > 0).alias("matched"), F.get(F.transform("matches", one), F.lit(0)).alias("rootCause"), F.transform("matches", one).alias("matches")))


def rows_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def code_quality(df: DataFrame) -> DataFrame:
    """Issues of rows ``(source, fingerprint, rule_id, title, fix, score, severity, line_number)``."""
    known = F.col("rule_id").isNotNull()
    text = F.when(~known, "The failure was not recognised.").when(F.trim(F.coalesce("fix", F.lit(""))) == "", F.col("title")).otherwise(F.concat("title", F.lit(" — "), first_line("fix")))
    level = F.when(known, sarif_level("score", "severity"))
    return df.select(
        F.to_json(
            F.struct(
                text.alias("description"), F.coalesce("rule_id", F.lit("unmatched")).alias("checkName"), F.col("fingerprint"), quality_severity(level).alias("severity"),
                F.struct(report_path("source").alias("path"), F.struct(F.coalesce("line_number", F.lit(1)).alias("begin")).alias("lines")).alias("location"),
            )
        ).alias("issue")
    )


def annotations(df: DataFrame) -> DataFrame:
    """Console commands that mark the lines of rows as for :func:`code_quality`."""
    where = F.concat(F.lit("::"), F.when(F.col("rule_id").isNull(), "notice").otherwise(F.regexp_replace(sarif_level("score", "severity"), "^note$", "notice")), F.lit(" file="), annotation_text(report_path("source"), True), F.lit(",line="), F.coalesce("line_number", F.lit(1)).cast("string"), F.lit(",title="), annotation_text(F.coalesce("title", F.lit("Unknown failure")), True))
    return df.select(F.concat(where, F.lit("::"), annotation_text(F.coalesce("fix", F.lit("")))).alias("command"))


def rules_json(rules: Iterable) -> str:
    """The rule inventory, by ecosystem and id; absent values are left out."""
    keys = ("id", "category", "title", "confidence", "severity", "docs", "enabled")
    rows = [{**{k: v for k in keys if (v := getattr(r, k)) is not None}, "ecosystems": list(r.declared)} for r in sorted(rules, key=lambda r: (r.declared[:1], r.id))]
    return json.dumps(rows, ensure_ascii=False)


def statistics_json(h: DataFrame, top: int = 10, ecosystems: int | None = None) -> str:
    """Totals, recurrence, time to resolve, ecosystems (all, or the first by name) and the most
    frequent failures, as one object."""
    from faultloom.operators import stats

    t, r, m = stats.totals(h).first(), stats.recurrence_rate(h).first(), stats.time_to_resolve(h).first()
    rows = [{"fingerprint": x.fingerprint, "ruleId": x.rule_id, "count": x.n, "openCount": x.open_count, "flaky": x.flaky, "lastSeen": x.last_seen.isoformat()} for x in stats.top_failures(h, top).collect()]
    by = stats.by_ecosystem(h).orderBy("ecosystem")
    eco = {x.ecosystem: x.n for x in (by if ecosystems is None else by.limit(ecosystems)).collect()}
    out = {**t.asDict(), "recurrenceRate": round(r.recurrence_rate, 4), "byEcosystem": eco, "topFailures": rows}
    if m.n:
        out |= {"meanTimeToResolutionSeconds": m.mean_us / 1e6, "resolvedWithTiming": m.n}
    return json.dumps(out, ensure_ascii=False)


def sarif(rows: Iterable[dict], tool: str = "faultloom") -> str:
    """SARIF 2.1.0 of rows as for :func:`code_quality`; rules are listed by first appearance."""
    rules: dict[str, int] = {}
    described, results = [], []
    for r in rows:
        rid = r.get("rule_id") or "unmatched"
        score, sev = r.get("score"), (r.get("severity") or "").lower()
        level = "note" if not r.get("rule_id") else sev if sev in ("error", "warning", "note") else "error" if score >= 0.8 else "warning" if score >= 0.6 else "note"
        if rid not in rules:
            rules[rid] = len(described)
            described.append({"id": rid, "shortDescription": {"text": r.get("title") or rid}, "defaultConfiguration": {"level": level}})
        path = (r.get("source") or "").split("::")[0].replace("\\", "/").strip() or "stdin"
        region = {"startLine": r.get("line_number") or 1}
        if r.get("matched_line"):
            region["snippet"] = {"text": r["matched_line"]}
        results.append(
            {"ruleId": rid, "ruleIndex": rules[rid], "level": level, "message": {"text": r.get("fix") or r.get("title") or "No known rule matched this log."}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": path}, "region": region}}], "partialFingerprints": {"failure/v1": r.get("fingerprint") or ""}}
        )
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": described}}, "results": results}]}, ensure_ascii=False)


def number(v: float) -> str:
    return f"{v:.6f}".rstrip("0").rstrip(".") or "0"


def _escape(v: str) -> str:
    return v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def prometheus(totals: dict, by_ecosystem: list[tuple[str, int]], top: list[tuple[str, str, int]], recurrence: float, flaky: int, mean_seconds: float | None = None, prefix: str = "build") -> str:
    """Text exposition of the statistics; ``top`` is ``(fingerprint, rule, count)``, already short."""
    out: list[str] = []

    def head(name: str, text: str) -> None:
        out.extend((f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} gauge"))

    def gauge(name: str, text: str, v: float) -> None:
        head(name, text)
        out.append(f"{prefix}_{name} {number(v)}")

    for k in ("total", "open", "resolved", "unmatched"):
        gauge(f"failures_{k}", f"Failures: {k}.", totals[k])
    gauge("recurrence_rate", "Share of distinct failures seen more than once.", recurrence)
    gauge("flaky_failures", "Distinct failures seen again after being resolved.", flaky)
    if mean_seconds is not None:
        gauge("mean_time_to_resolution_seconds", "Mean time from first sighting to resolution.", mean_seconds)
    head("failures_by_ecosystem", "Failures by ecosystem.")
    out += [f'{prefix}_failures_by_ecosystem{{ecosystem="{_escape(k)}"}} {n}' for k, n in by_ecosystem]
    head("failure_occurrences", "Occurrences of the most frequent failures.")
    out += [f'{prefix}_failure_occurrences{{fingerprint="{_escape(f)}",rule="{_escape(r)}"}} {n}' for f, r, n in top]
    return "\n".join(out) + "\n"


def markdown(rows: list[dict], detailed: int = 20, listed: int = 100) -> str:
    """Summary of analyses: the first ones in detail, further ones as a list."""
    hit = sum(1 for r in rows if r.get("rule_id"))
    out = [f"## Failures: {hit} of {len(rows)} explained", ""]
    for r in rows[:detailed]:
        out += [f"### {r.get('title') or 'Unknown failure'}", "", f"- Source: `{r.get('source')}`", f"- Fingerprint: `{r.get('fingerprint')}`"]
        if r.get("fix"):
            out.append(f"- Fix: {r['fix']}")
        out.append("")
    out += [f"- `{r.get('fingerprint')}` {r.get('title') or 'unknown'}" for r in rows[detailed:listed]]
    if len(rows) > listed:
        out.append(f"- … and {len(rows) - listed} more")
    return "\n".join(out).rstrip() + "\n"


def sparkline(counts: list[int], width: int = 100, height: int = 24) -> str:
    """Points of a polyline scaled to the peak."""
    if not counts:
        return ""
    peak, step = max(max(counts), 1), width / max(1, len(counts) - 1)
    return " ".join(f"{number(round(i * step, 1))},{number(round(height - c / peak * height, 1))}" for i, c in enumerate(counts))
