"""Scalar text functions as pure Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define normalised and scrubbed text.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
LINE_STAMP = r"(?m)^[^\S\n]*(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\[\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\])[^\S\n]*"
WINDOWS_PATH = r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\?)+'
UNIX_PATH = r"(?U)(?<![\w-])/(?:[^/\s:]+/)+[^/\s:]*"
GUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"(?U)\b0x[0-9a-fA-F]+\b"
NUMBER = r"(?U)\b\d+\b"
TERM = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"

WINDOW_CHARS = 8 * 1024 * 1024
EXCERPT_CHARS = 2000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space on both sides (``trim`` knows only the space)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+\z", "")


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), ANSI, "")


def unify_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def window_text(c: Column | str, cap: int | None = None, marker: str = "[... log truncated ...]") -> Column:
    """Texts over ``cap`` keep a head quarter and a tail, both at line ends, around a marker.

    By default nothing is cut; ``WINDOW_CHARS`` is the customary cap.
    """
    c = _c(c)
    if cap is None:
        return c
    head_len = cap // 4
    tail_len = cap - head_len - len(marker) - 2
    head = F.left(c, F.lit(head_len))
    cut = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    head = F.when(cut > 0, F.left(head, cut - 1)).otherwise(head)
    tail = F.right(c, F.lit(tail_len))
    nl = F.locate("\n", tail)
    tail = F.when(nl > 0, F.substring(tail, nl + 1, F.length(tail))).otherwise(tail)
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(head, F.lit("\n" + marker + "\n"), tail))


def normalize(c: Column | str) -> Column:
    """No escapes, LF line ends, no leading line stamps, right-trimmed lines, no trailing LFs."""
    t = F.regexp_replace(unify_newlines(strip_ansi(c)), LINE_STAMP, "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|\z)", ""), r"\n+\z", "")


def scrub(c: Column | str) -> Column:
    """Volatile parts (paths, GUIDs, hex, numbers) become placeholders; lower case; trimmed."""
    t = strip_ansi(c)
    for pattern, to in ((WINDOWS_PATH, "<path>"), (UNIX_PATH, "<path>"), (GUID, "<guid>"), (HEX, "<hex>"), (NUMBER, "<n>")):
        t = F.regexp_replace(t, pattern, to)
    return utrim(F.lower(t))


def term_list(c: Column | str) -> Column:
    """Terms of a text with repeats, in text order."""
    all_terms = F.regexp_extract_all(scrub(c), F.lit(TERM), F.lit(0))
    return F.filter(all_terms, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def term_counts(c: Column | str) -> Column:
    """``map<string,int>``: terms of a text with their counts, by the runs of the sorted terms."""

    def runs(ts: Column) -> Column:
        starts = F.array_compact(F.transform(ts, lambda t, i: F.when((i == 0) | (t != F.get(ts, i - 1)), i)))
        return _let(starts, lambda at: F.map_from_entries(F.transform(at, lambda p, k: F.struct(F.get(ts, p).alias("key"), (F.coalesce(F.get(at, k + 1), F.size(ts)) - p).alias("value")))))

    return _let(F.array_sort(term_list(c)), runs)


def row_terms(tokens: Column | str = "tokens", excerpt: Column | str = "excerpt") -> Column:
    """Distinct terms of a history row: the stored keys, else those of its normalised excerpt."""
    tokens, excerpt = _c(tokens), _c(excerpt)
    return F.coalesce(F.map_keys(tokens), F.array_distinct(term_list(normalize(excerpt))), F.array().cast("array<string>"))


def lines(c: Column | str) -> Column:
    return F.split(_c(c), "\n")


def error_like_lines(text: Column | str) -> Column:
    """First five lines that speak of errors, else the last five non-blank ones."""

    def pick(ls: Column) -> Column:
        bad = F.filter(ls, lambda x: F.lower(x).rlike("error|fail|exception"))
        full = F.filter(ls, lambda x: x.rlike(r"\S"))
        last = lambda f: F.slice(f, F.size(f) - F.least(F.lit(5), F.size(f)) + 1, 5)
        return _let(bad, lambda b: F.when(F.size(b) > 0, F.slice(b, 1, 5)).otherwise(_let(full, lambda f: F.when(F.size(f) > 0, last(f)).otherwise(F.array().cast("array<string>")))))

    return _let(lines(text), pick)


def fingerprint(rule_id: Column | str, signature: Column | str) -> Column:
    r = _c(rule_id)
    return F.concat(r, F.lit(":"), F.left(F.sha2(F.concat(r, F.lit("\n"), scrub(signature)), 256), F.lit(12)))


def log_hash(raw: Column | str) -> Column:
    return F.sha2(_c(raw), 256)


def excerpt(block: Column | str, cap: int = EXCERPT_CHARS) -> Column:
    return F.left(utrim(block), F.lit(cap))


def tail_excerpt(text: Column | str, n: int = 6000) -> Column:
    return F.right(utrim(text), F.lit(n))


def line_number_at(text: Column | str, position: Column) -> Column:
    """1-based line of a 1-based character position; a position on a newline opens the next line."""
    t = _c(text)
    p = F.greatest(F.lit(1), F.least(position, F.length(t)))
    return F.size(F.split(F.left(t, p), "\n"))


def context_before(ls: Column, line: Column, n: int = 3) -> Column:
    """Up to n right-trimmed lines before a 1-based line, blank outer lines dropped."""
    start = F.greatest(F.lit(1), line - n)
    part = F.transform(F.slice(ls, start, line - start), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    first = F.array_position(F.transform(part, lambda x: x != ""), True)
    return F.when(first > 0, F.slice(part, first.cast("int"), F.size(part))).otherwise(F.array().cast("array<string>"))


def context_after(ls: Column, line: Column, n: int = 3) -> Column:
    take = F.greatest(F.lit(0), F.least(F.lit(n), F.size(ls) - line))
    part = F.transform(F.slice(ls, line + 1, take), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    last = F.array_position(F.reverse(F.transform(part, lambda x: x != "")), True)
    return F.when(last > 0, F.slice(part, 1, F.size(part) - last.cast("int") + 1)).otherwise(F.array().cast("array<string>"))


def interpolate(template: Column | str, captures: Column) -> Column:
    """``{name}`` becomes the capture of that name, in one pass: what is filled in is not looked at
    again. Unknown names stay."""
    parts = F.regexp_extract_all(_c(template), F.lit(r"(?s)\{\w+\}|[^{]+|\{"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.when(x.rlike(r"\A\{\w+\}\z"), F.try_element_at(captures, F.regexp_replace(x, r"[{}]", ""))), x)), "")


def test_name(source: Column | str) -> Column:
    """What follows the first ``::``, trimmed; null when absent or blank."""
    s = _c(source)
    at = F.locate("::", s)
    return F.when(at > 0, F.nullif(utrim(F.substring(s, at + 2, F.length(s))), F.lit("")))


def without_arguments(name: Column | str) -> Column:
    return utrim(F.substring_index(_c(name), "(", 1))


def same_commit(a: Column | str, b: Column | str) -> Column:
    a, b = F.lower(_c(a)), F.lower(_c(b))
    return F.coalesce((F.length(a) >= 7) & (F.length(b) >= 7) & (F.startswith(a, b) | F.startswith(b, a)), F.lit(False))


def confidence_bucket(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low")


def sarif_level(score: Column | str, severity: Column | str) -> Column:
    s, v = _c(score), F.lower(utrim(_c(severity)))
    return F.when(v.isin("error", "warning", "note"), v).when(s >= 0.8, "error").when(s >= 0.6, "warning").otherwise("note")


def quality_severity(level: Column | str) -> Column:
    v = _c(level)
    return F.when(v == "error", "major").when(v == "warning", "minor").otherwise("info")


def report_path(source: Column | str) -> Column:
    p = F.replace(F.substring_index(_c(source), "::", 1), F.lit("\\"), F.lit("/"))
    return F.when(F.coalesce(utrim(p), F.lit("")) == "", "stdin").otherwise(p)


def first_line(c: Column | str, cap: int = 200) -> Column:
    return F.left(F.substring_index(_c(c), "\n", 1), F.lit(cap))


def fingerprint_rule(fp: Column | str) -> Column:
    return F.substring_index(_c(fp), ":", 1)


def assembly_name(path: Column | str) -> Column:
    base = F.regexp_extract(_c(path), r"([^/\\]*)\z", 1)
    return F.regexp_replace(base, r"(?i)\.(dll|exe)\z", "")


def class_name(c: Column | str) -> Column:
    return utrim(F.substring_index(_c(c), ",", 1))


def short_sha(c: Column | str, n: int = 7) -> Column:
    return F.left(_c(c), F.lit(n))


def prometheus_label(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def annotation_text(c: Column | str, prop: bool = False) -> Column:
    t = _c(c)
    for a, b in [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if prop else []):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def state_label(flaky: Column | str, open_count: Column | str, count: Column | str) -> Column:
    f, o, n = _c(flaky), _c(open_count), _c(count)
    return F.when(f, "flaky").when(o == 0, "resolved").when(o == n, "open").otherwise(F.concat(o.cast("string"), F.lit(" open")))


def event_title(event: Column | str, title: Column | str) -> Column:
    e, t = _c(event), _c(title)
    return F.when(e == "new-failure", F.concat(F.lit("New failure: "), t)).when(e == "recurrence", F.concat(F.lit("Recurring failure: "), t)).when(e == "resolved", F.concat(F.lit("Resolved: "), t))


def humanize_seconds(c: Column | str) -> Column:
    """Largest fitting unit with at most one decimal."""
    s = _c(c)
    fmt = lambda x, u: F.concat(F.regexp_replace(F.bround(x, 1).cast("string"), r"\.0\z", ""), F.lit(u))
    return F.when(s >= 86400, fmt(s / 86400, "d")).when(s >= 3600, fmt(s / 3600, "h")).when(s >= 60, fmt(s / 60, "m")).otherwise(fmt(s, "s"))


def json_object(c: Column | str) -> Column:
    """From the first ``{`` to the last ``}`` of prose, or null."""
    return F.nullif(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), F.lit(""))


def embedding_from_json(c: Column | str) -> Column:
    v = F.from_json(_c(c), "array<float>")
    return F.when(F.size(v) > 0, v)
