"""The failure history: filters, pages, state changes. All are projections of append-only tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.text import utrim
from faultloom.session import Scratch

# Accepted spellings of ecosystems.
ECOSYSTEM_NAMES = {
    "dotnet": ("dotnet", "net", ".net", "csharp", "nuget", "msbuild"),
    "node": ("node", "npm", "js", "javascript", "yarn", "pnpm"),
    "python": ("python", "py", "pip"),
    "java": ("java", "maven", "mvn", "gradle", "kotlin", "kt", "jvm"),
    "go": ("go", "golang"),
    "rust": ("rust", "cargo", "rs"),
    "ruby": ("ruby", "rb", "bundler", "gem", "rails"),
    "php": ("php", "composer", "phpunit"),
    "cpp": ("cpp", "c++", "c", "gcc", "clang", "g++", "cmake", "make"),
    "infra": ("infra", "docker", "dockerfile", "terraform", "tf", "tofu", "opentofu", "k8s", "kubernetes", "kubectl", "helm"),
    "scala": ("scala", "sbt"),
    "elixir": ("elixir", "ex", "mix", "erlang"),
    "swift": ("swift", "xcode", "xcodebuild", "ios"),
    "android": ("android", "aapt"),
    "generic": ("generic", "ci"),
}


def ecosystem_name(c: str):
    """Canonical ecosystem of any accepted spelling, else ``unknown``."""
    key = F.lower(utrim(c))
    out = F.lit("unknown")
    for name, spellings in ECOSYSTEM_NAMES.items():
        out = F.when(key.isin(*spellings), name).otherwise(out)
    return out


def parse_since(text: str, now: datetime) -> datetime:
    """``N`` with m, h, d or w back from ``now``, or a date taken as UTC; ValueError otherwise."""
    if m := re.fullmatch(r"\s*(\d+)\s*([mhdw])\s*", text, re.I):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2].lower()]
        return now - timedelta(**{unit: int(m[1])})
    d = datetime.fromisoformat(text.strip())
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def parse_duration(text: str) -> timedelta:
    """``N`` with d, w, mo (30 days) or y (365 days); decimals allowed; must be positive."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(d|w|mo|y)\s*", text, re.I)
    if not m or float(m[1]) <= 0:
        raise ValueError(f"no duration: {text!r}")
    return timedelta(days=float(m[1]) * {"d": 1, "w": 7, "mo": 30, "y": 365}[m[2].lower()])


def scoped(h: DataFrame, since=None, repo: str | None = None) -> DataFrame:
    """``since`` is inclusive, the repository is matched exactly."""
    if since is not None:
        h = h.where(F.col("analyzed_at") >= F.lit(since).cast("timestamp"))
    if repo is not None:
        h = h.where(F.col("repo_id") == repo)
    return h


def filtered(h: DataFrame, since=None, repo=None, status=None, rule=None, ecosystem=None, search=None) -> DataFrame:
    """Blank conditions do not filter; ecosystem ignores case; search is a literal substring of
    source, fingerprint or excerpt in any letter case."""
    h = scoped(h, since, repo or None)
    if status:
        h = h.where(F.col("status") == status)
    if rule:
        h = h.where(F.col("rule_id") == rule)
    if ecosystem:
        h = h.where(F.lower("ecosystem") == ecosystem.lower())
    if search and search.strip():
        q = F.lit(search.lower())
        h = h.where(F.contains(F.lower("source"), q) | F.contains(F.lower("fingerprint"), q) | F.contains(F.lower("excerpt"), q))
    return h


def page(h: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, that is by falling id."""
    return h.orderBy(F.desc("id")).offset(max(0, offset)).limit(max(1, limit))


def page_count(total: int, size: int = 50) -> int:
    return max(1, -(-total // size))


def open_failures(h: DataFrame, repo: str | None = None) -> DataFrame:
    return scoped(h, repo=repo).where("status = 'open'")


def next_ids(h: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with status open and ids that follow the history's largest, in order of ``seq``.

    Rows are ordered in ranges; a range's ids begin after the sizes of those before it, so no task
    sees more than its range.
    """
    top = h.agg(F.max("id")).first()[0] or 0
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = new.repartitionByRange(n, "seq").sortWithinPartitions("seq").withColumn("__at", F.monotonically_increasing_id())
    x = Scratch(new.sparkSession).save(x.withColumn("__part", F.shiftright("__at", 33)))
    sizes = x.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a number a range
    before, total = [], top
    for r in sizes:
        before.append((r["__part"], total))
        total += r.n
    first = new.sparkSession.createDataFrame(before, "__part long, __before long")
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return x.join(F.broadcast(first), "__part").withColumn("id", at).withColumn("status", F.lit("open")).drop("__part", "__at", "__before")


def fold_resolutions(h: DataFrame, events: DataFrame) -> DataFrame:
    """History with ``events (id, seq, kind, note, at, commit)`` applied.

    A manual resolution always wins, the latest of several; an automatic one counts only on a row
    still open, the first of several. A manual one after an automatic one keeps its commit.
    """
    manual = events.where("kind = 'manual'").groupBy("id").agg(F.max_by(F.struct("note", "at"), "seq").alias("m"))
    auto = events.where("kind = 'auto'").groupBy("id").agg(F.min_by(F.struct("note", "at", "commit", "seq"), "seq").alias("a"))
    first_manual = events.where("kind = 'manual'").groupBy("id").agg(F.min("seq").alias("ms"))
    x = h.join(manual, "id", "left").join(auto, "id", "left").join(first_manual, "id", "left")
    was_open = F.coalesce(F.col("status"), F.lit("open")) == "open"
    auto_holds = was_open & F.col("a").isNotNull() & (F.col("ms").isNull() | (F.col("a.seq") < F.col("ms")))
    pick = lambda m, a, old: F.when(F.col("m").isNotNull(), m).when(auto_holds, a).otherwise(old)
    return x.select(
        *[c for c in h.columns if c not in ("resolution", "resolved_at", "resolution_source", "resolved_commit", "status")],
        pick(F.col("m.note"), F.col("a.note"), F.col("resolution")).alias("resolution"),
        pick(F.col("m.at"), F.col("a.at"), F.col("resolved_at")).alias("resolved_at"),
        pick(F.lit("manual"), F.lit("auto"), F.col("resolution_source")).alias("resolution_source"),
        F.when(auto_holds, F.col("a.commit")).otherwise(F.col("resolved_commit")).alias("resolved_commit"),
        pick(F.lit("resolved"), F.lit("resolved"), F.col("status")).alias("status"),
    )


def backfill_status(h: DataFrame) -> DataFrame:
    """Rows without a status are resolved if they hold a resolution, else open."""
    return h.withColumn("status", F.coalesce("status", F.when(F.col("resolution").isNotNull(), "resolved").otherwise("open")))


def prune_survivors(h: DataFrame, cutoff, resolved_only: bool = False) -> DataFrame:
    """What stays when rows analysed strictly before ``cutoff`` are deleted."""
    gone = F.col("analyzed_at") < F.lit(cutoff).cast("timestamp")
    if resolved_only:
        gone = gone & F.coalesce(F.col("status") == "resolved", F.lit(False))
    return h.where(~F.coalesce(gone, F.lit(False)))


def new_or_recurring(h: DataFrame) -> DataFrame:
    """``(id, event)``: whether a row's fingerprint had been seen before, in id order.

    The first id of each fingerprint is found by a partial aggregate, so a hot fingerprint needs
    no sorted partition of its own.
    """
    first = h.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
    return h.select("id", "fingerprint").join(first, "fingerprint").select("id", F.when(F.col("id") > F.col("first_id"), "recurrence").otherwise("new-failure").alias("event"))
