"""Optional helpers behind injected callables: suggestions, embeddings, drafted rules."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.operators.rules import Rule, lint

UNSURE = 0.6
# What is left of a pattern for anything at all, without its anchors and brackets.
OVER_BROAD = ("", ".*", ".+", ".*?", ".+?", "[\\s\\S]*", "[\\s\\S]+", "(?s).*")
#: texts that no pattern for a failure may match
NEUTRAL = ("", "zq", "17", "Lorem ipsum dolor sit amet\nconsectetur\n")


def suggestions(df: DataFrame, ask: Callable[[str], tuple[str, str, str] | None], text: str = "text", chars: int = 6000) -> DataFrame:
    """``(id, model, root_cause, fix)`` for rows without a match or with a best score below 0.6.
    Only the tail of a text is asked about; a callable that fails gives no suggestion."""
    best = F.try_element_at("matches", F.lit(1))["score"]
    rows = df.where(best.isNull() | (best < UNSURE)).select("id", F.right(F.trim(text), F.lit(chars)).alias("t"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for i, t in zip(pdf["id"], pdf["t"]):
                try:
                    got = ask(t)
                except Exception:  # noqa: BLE001
                    got = None
                if got:
                    out.append((i, *got))
            yield pd.DataFrame(out, columns=["id", "model", "root_cause", "fix"])

    return rows.mapInPandas(run, "id long, model string, root_cause string, fix string")


def hashing_embedding(text: str, size: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def embeddings(df: DataFrame, embed: Callable[[str], list[float] | None], text: str = "text", chars: int = 8000) -> DataFrame:
    """``df`` with ``embedding array<float>``, null where the callable fails or has none."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return embed(t) or None if t else None
            except Exception:  # noqa: BLE001
                return None

        return s.map(one)

    return df.withColumn("embedding", run(F.right(F.trim(text), F.lit(chars))))


def draft_rule(reply: str) -> Rule | None:
    """The rule in a model's reply: the JSON from its first to its last brace."""
    m = re.search(r"\{.*\}", reply, re.S)
    try:
        o = json.loads(m[0]) if m else None
    except ValueError:
        return None
    if not isinstance(o, dict) or not (o.get("match") or o.get("title")):
        return None
    return Rule(o.get("id") or "", o.get("match") or "", o.get("ecosystem") or "generic", (), o.get("category") or "general", o.get("title") or "", 0.5, o.get("fix") or "")


def too_broad(pattern: str) -> bool:
    """Whether a pattern says nothing: by its form, or as it matches any text, even an empty one."""
    bare = pattern.strip()
    if bare in OVER_BROAD or bare.strip("^$() ") in OVER_BROAD:
        return True
    try:
        p = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", bare), re.I | re.M)
    except re.error:
        return False
    return any(p.search(t) for t in NEUTRAL)


def draft_problems(rule: Rule, text: str, most: int = 20) -> list[str]:
    """Why a drafted rule should not be added; it must match its own log, at most ``most`` times."""
    bad = lint(rule)
    if too_broad(rule.match):
        bad.append("the pattern is too broad")
    try:
        n = sum(1 for _ in re.finditer(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", rule.match), text, re.I | re.M))
    except re.error:
        return bad
    if not n:
        bad.append("the pattern does not match the log")
    elif n > most:
        bad.append(f"the pattern matches {n} times")
    return bad
