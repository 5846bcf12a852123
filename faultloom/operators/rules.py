"""Rule packs compiled to literal expressions; matching, guards, ranking and evidence.

A pack is small and declared by people, so it is compiled on the driver. Each rule becomes one
``when`` branch with its own literal pattern, which the JVM compiles once per task; a text is
searched by a rule only if it holds the rule's required literal. All matches of a text form one
array in its row, so matching and ranking move no data.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions.text import context_after, context_before, interpolate, line_number_at, lines, utrim

MAX_RULES = 5_000
FLAGS = "(?dimuU)"
OCCURRENCES = 100
#: an ecosystem also takes the rules of its parent
PARENTS = {"android": "java", "scala": "java"}


@dataclass(frozen=True)
class Rule:
    id: str
    match: str
    ecosystem: str = "generic"
    ecosystems: tuple[str, ...] = ()
    category: str = "general"
    title: str = ""
    confidence: float = 0.5
    fix: str = ""
    docs: str | None = None
    severity: str | None = None
    not_match: str | None = None
    requires: str | None = None
    enabled: bool = True
    seq: int = field(default=0, compare=False)

    @property
    def declared(self) -> tuple[str, ...]:
        """All ecosystems, its own first, each once."""
        return tuple(dict.fromkeys(e.lower() for e in (self.ecosystem, *self.ecosystems) if e))


def rules_from(df: DataFrame) -> list[Rule]:
    """A rule table as a pack. Rows without id or, unless disabled, without pattern are dropped."""
    rows = df.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a pack of more than {MAX_RULES} rules is not broadcast")
    out = []
    for i, r in enumerate(rows):
        d = r.asDict()
        if not (d.get("id") or "").strip() or (d.get("enabled") is not False and not (d.get("match") or "").strip()):
            continue
        own = d.get("ecosystem")
        more = tuple(d.get("ecosystems") or ())
        out.append(
            Rule(
                d["id"], d.get("match") or "", own if own is not None else ("" if more else "generic"), more, d.get("category") or "general", d.get("title") or "", 0.5 if d.get("confidence") is None else d["confidence"],
                d.get("fix") or "", d.get("docs"), d.get("severity"), d.get("not_match"), d.get("requires"), d.get("enabled") is not False, i,
            )
        )
    return out


def override(*tiers: list[Rule]) -> list[Rule]:
    """Union of tiers; a later rule replaces an earlier one of the same id in any letter case."""
    held: dict[str, Rule] = {}
    for tier in tiers:
        for r in tier:
            held[r.id.lower()] = r
    return list(held.values())


def duplicates(*tiers: list[Rule]) -> tuple[list[str], list[str]]:
    """``(errors, warnings)``: ids repeated within a tier; ids of one tier redefined in another."""
    errors, seen, warnings = [], set(), []
    for tier in tiers:
        ids = Counter(r.id.lower() for r in tier)
        errors += sorted(i for i, n in ids.items() if n > 1)
        warnings += sorted(set(ids) & seen)
        seen |= set(ids)
    return errors, warnings


def alternatives(pattern: str) -> list[str]:
    """Branches of a pattern's top-level alternation."""
    out, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>|\(\?'([A-Za-z_]\w*)'")


def lint(rule: Rule) -> list[str]:
    """Problems of one rule, as messages."""
    bad = []
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", rule.id):
        bad.append("id is not kebab-case")
    if not 0 < rule.confidence <= 1:
        bad.append("confidence must lie in (0, 1]")
    if rule.severity is not None and rule.severity not in ("error", "warning", "note"):
        bad.append("unknown severity")
    if rule.enabled and not rule.match.strip():
        bad.append("an enabled rule needs a pattern")
    for name, p in (("match", rule.match), ("not_match", rule.not_match), ("requires", rule.requires)):
        try:
            re.compile(_NAMED.sub(lambda m: "(", p or ""))
        except re.error as x:
            bad.append(f"{name}: {x}")
    for want in set(re.findall(r"\{(\w+)\}", rule.fix)):
        for branch in alternatives(rule.match) if rule.match else []:
            if want not in [a or b for a, b in _NAMED.findall(branch)]:
                bad.append(f"placeholder {{{want}}} is not captured by every branch")
                break
    return bad


def renamed_groups(pattern: str) -> tuple[str, dict[str, list[int]]]:
    """The pattern with plain groups instead of named ones, and each name's group numbers.

    A name may occur several times, which Java rejects; its last group that took part counts.
    """
    out, names, i, n, in_class = [], {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            m = _NAMED.match(pattern, i)
            if m:
                n += 1
                names.setdefault(m[1] or m[2], []).append(n)
                out.append("(")
                i = m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                n += 1
        out.append(c)
        i += 1
    return "".join(out), names


#: quoting, comments and free spacing, in which characters mean something else
_DOUBT = re.compile(r"\\[QE]|\(\?#|\(\?[a-zA-Z]*x")
_ESCAPE = re.compile(r"\\(?:x\{\w+\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[pP]\{[^{}]+\}|[pP]\w|N\{[^{}]+\}|k<\w+>|c.|0[0-7]{1,3}|[1-9]\d*|[dDwWsSbBAzZGhHvVRXntrfae]|[^\w])", re.DOTALL)
_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\[\]\\])*\]", re.DOTALL)
_RANGED = re.compile(r"\{\w+(?:,\d*)?\}")


def required_literal(pattern: str, unicode_case: bool = True) -> str:
    """A lower-case literal that every match must hold, or nothing if none can be proven.

    Quantifiers, classes and escapes with their arguments are passed over as a whole; a form that
    is not known proves nothing.
    """
    if len(alternatives(pattern)) > 1 or _DOUBT.search(pattern):
        return ""
    best = run = ""
    i, depth = 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1 : i + 2]
        if depth == 0 and (c.isalnum() or c in " :'=,;_<>/\"%&#@!~-") and c.isascii():
            if nxt in ("?", "*", "{"):
                best, run = max(best, run, key=len), ""
            else:
                run += c
        else:
            best, run = max(best, run, key=len), ""
            whole = {"\\": _ESCAPE, "[": _CLASS, "{": _RANGED}.get(c)
            if whole:
                m = whole.match(pattern, i)
                if not m:
                    return ""
                i = m.end() - 1
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
        i += 1
    best = max(best, run, key=len).lower()
    if not unicode_case:
        return best if len(best) >= 3 else ""
    # letters that fold to several characters cannot be compared by lower() alone
    return best if len(best) >= 4 and not set(best) & set("ksi") or len(best) >= 8 and best.isascii() and not re.search("[kK]", best) else ""


def applies(rule: Rule, ecosystem: Column) -> Column:
    declared = list(rule.declared)
    if "generic" in declared:
        return F.lit(True)
    e = F.coalesce(F.lower(utrim(ecosystem)), F.lit("unknown"))
    children = [c for c, p in PARENTS.items() if p in declared]
    return e.isin("generic", "unknown", "", *declared, *children)


def _found(text: Column, low: Column, pattern: str) -> Column:
    lit = required_literal(pattern)
    hit = text.rlike(FLAGS + pattern)
    return F.contains(low, F.lit(lit)) & hit if lit else hit


def compiles(pattern: str) -> bool:
    """Whether the engine accepts a pattern, as it will be used."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(FLAGS + pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def usable(rules: list[Rule]) -> list[Rule]:
    """Enabled rules whose patterns the engine accepts; others are left out with a warning, so one
    bad rule fails nothing. A broken guard leaves out its rule as well."""
    out = []
    for r in sorted(rules, key=lambda r: r.id):
        if not r.enabled or not r.match:
            continue
        bad = [p for p in (r.match, r.requires, r.not_match) if p and p.strip() and not compiles(renamed_groups(p)[0])]
        if bad:
            logging.getLogger(__name__).warning("rule %s is left out, its pattern is not valid: %s", r.id, bad[0])
        else:
            out.append(r)
    return out


def match_array(rules: list[Rule], text: Column, ecosystem: Column) -> Column:
    """Matches of a text, best first: by falling score, then rule id."""
    low = F.lower(text)
    branches = []
    for r in usable(rules):
        plain, names = renamed_groups(r.match)
        cond = applies(r, ecosystem) & _found(text, low, plain)
        if r.requires and r.requires.strip():
            cond = cond & _found(text, low, renamed_groups(r.requires)[0])
        if r.not_match and r.not_match.strip():
            cond = cond & ~_found(text, low, renamed_groups(r.not_match)[0])
        full = F.lit(FLAGS + plain)
        pairs = [F.struct(F.lit(n).alias("key"), utrim(reduce(lambda a, b: F.coalesce(b, a), [F.nullif(F.regexp_extract(text, FLAGS + plain, g), F.lit("")) for g in groups])).alias("value")) for n, groups in names.items()]
        caps = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
        branches.append(
            F.when(
                cond,
                F.struct(
                    (-F.lit(float(r.confidence))).alias("neg"), F.lit(r.id).alias("rule_id"), F.lit(float(r.confidence)).alias("score"), F.lit(r.title).alias("title"), F.lit(r.category).alias("category"), F.lit(r.severity).cast("string").alias("severity"),
                    F.lit(r.docs).cast("string").alias("docs"), F.lit(r.fix).alias("fix_template"), caps.alias("captures"), F.regexp_instr(text, full).alias("position"), F.least(F.lit(OCCURRENCES), F.regexp_count(text, full)).cast("int").alias("occurrences"),
                ),
            )
        )
    if not branches:
        raise ValueError("no enabled rule with a valid pattern")
    # sorted by hand on the two leading fields: maps have no order
    return F.array_sort(F.array_compact(F.array(*branches)), lambda a, b: F.when(a["neg"] < b["neg"], -1).when(a["neg"] > b["neg"], 1).when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0))


def match_rules(logs: DataFrame, rules: list[Rule], text: str = "text", ecosystem: str = "ecosystem") -> DataFrame:
    """``logs`` plus ``matches``, an array of structs, best first; empty where nothing matched."""
    return logs.withColumn("matches", match_array(rules, F.col(text), F.col(ecosystem)))


def with_evidence(matched: DataFrame, text: str = "text", around: int = 3) -> DataFrame:
    """One row per match with rank, line, context, captures and the filled-in fix."""
    x = matched.select("*", F.posexplode("matches").alias("pos", "m"))
    t, ls = F.col(text), lines(F.col(text))
    n = line_number_at(t, F.col("m.position"))
    return x.select(
        *[c for c in matched.columns if c != "matches"],
        (F.col("pos") + 1).alias("rank"),
        *[F.col(f"m.{c}").alias(c) for c in ("rule_id", "score", "title", "category", "severity", "docs", "captures", "occurrences")],
        interpolate(F.col("m.fix_template"), F.col("m.captures")).alias("fix"),
        n.alias("line_number"),
        utrim(F.element_at(ls, n)).alias("matched_line"),
        context_before(ls, n, around).alias("before"),
        context_after(ls, n, around).alias("after"),
    )

