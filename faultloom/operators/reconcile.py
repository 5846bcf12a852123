"""Failures that later commits have probably fixed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heads(commits: DataFrame) -> DataFrame:
    """``(repo_id, head)``: of the commits that nobody has as parent, the largest sha."""
    c = commits.select("repo_id", "sha").distinct()
    p = commits.select("repo_id", F.explode("parents").alias("sha")).distinct()
    return c.join(p, ["repo_id", "sha"], "left_anti").groupBy("repo_id").agg(F.max("sha").alias("head"))


def reach(parents: dict[str, list[str]], start: str) -> set[str]:
    """``start`` and all its ancestors."""
    seen, todo = {start}, [start]
    while todo:
        for p in parents.get(todo.pop(), ()):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def _graph(t: pa.Table) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for sha, ps in zip(t.column("sha").to_pylist(), t.column("parents").to_pylist()):
        out.setdefault(sha, []).extend(ps or [])
    return out


def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """``(repo_id, start, sha)``: each start and all its ancestors.

    One repository's graph of sha and parents is walked in one task: a chain of n commits would
    need n joins otherwise. Starts are ``(repo_id, start)``; nulls are ignored; repeats are one.
    """
    schema = "repo_id string, start string, sha string"

    def walk(c: pa.Table, s: pa.Table) -> pa.Table:
        graph = _graph(c)
        rows = [(r, st, a) for r, st in set(zip(s.column("repo_id").to_pylist(), s.column("start").to_pylist())) for a in sorted(reach(graph, st))]
        return pa.table({n: pa.array([x[i] for x in rows], pa.string()) for i, n in enumerate(("repo_id", "start", "sha"))})

    fresh = lambda df, *cs: df.select(*[F.col(c).alias(c) for c in cs])  # noqa: E731  starts may stem from commits
    edges = fresh(commits, "repo_id", "sha", "parents").where("repo_id IS NOT NULL AND sha IS NOT NULL")
    starts = fresh(starts, "repo_id", "start").where("repo_id IS NOT NULL AND start IS NOT NULL")
    return edges.groupBy("repo_id").cogroup(starts.groupBy("repo_id")).applyInArrow(walk, schema)


def commits_between(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(repo_id, old, new, sha)``: what ``new`` reaches and ``old`` does not."""
    a = ancestors(commits, pairs.select("repo_id", F.col("new").alias("start")))
    b = ancestors(commits, pairs.select("repo_id", F.col("old").alias("start")))
    have = pairs.join(a.withColumnRenamed("start", "new"), ["repo_id", "new"])
    return have.join(b.withColumnRenamed("start", "old"), ["repo_id", "old", "sha"], "left_anti").select("repo_id", "old", "new", "sha")


def likely_fixed(h: DataFrame, commits: DataFrame, heads_: DataFrame, observed: DataFrame) -> DataFrame:
    """``(id, fingerprint, head)``: open rows of an ancestor of the head, not of the head itself,
    whose fingerprint was not observed at the head."""
    reached = ancestors(commits, heads_.select("repo_id", F.col("head").alias("start"))).select("repo_id", F.col("start").alias("head"), F.col("sha").alias("git_commit"))
    rows = h.where("status = 'open' AND git_commit <> ''").join(observed.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return rows.join(reached, ["repo_id", "git_commit"]).where("git_commit <> head").select("id", "fingerprint", "head")


def resolution_events(fixed: DataFrame, at, between: DataFrame | None = None) -> DataFrame:
    """Events ``(id, seq, kind, note, at, commit)`` of rows found by :func:`likely_fixed`, for
    :func:`faultloom.operators.history.fold_resolutions`.

    ``between`` gives ``(id, subjects array<string>)`` of the commits since the failure. A row
    found under several heads is resolved by the smallest.
    """
    x = fixed.groupBy("id").agg(F.min("head").alias("head"))
    x = x.join(between, "id", "left") if between is not None else x.withColumn("subjects", F.lit(None).cast("array<string>"))
    told = note(F.col("head"), F.coalesce("subjects", F.array().cast("array<string>")))
    return x.select("id", F.lit(0).cast("long").alias("seq"), F.lit("auto").alias("kind"), told.alias("note"), F.lit(at).cast("timestamp").alias("at"), F.col("head").alias("commit"))


# The wording of notes.
NOTE = "Likely fixed by {head} — auto-detected."
NOTE_COMMITS = " Commits since the failure:\n"


def note(head, subjects, shown: int = 3):
    """Text of an automatic resolution as a Column, from the head and ``array<string>`` subjects."""
    n = F.size(subjects)
    listed = F.concat_ws("\n", F.transform(F.slice(subjects, 1, shown), lambda s: F.concat(F.lit("  - "), s)))
    more = F.when(n > shown, F.concat(F.lit("\n  …and "), (n - shown).cast("string"), F.lit(" more commit(s)."))).otherwise("")
    first = F.concat(F.lit(NOTE.split("{head}")[0]), F.left(head, F.lit(7)), F.lit(NOTE.split("{head}")[1]))
    return F.when(n > 0, F.concat(first, F.lit(NOTE_COMMITS), listed, more)).otherwise(first)


__all__ = ["ancestors", "commits_between", "heads", "likely_fixed", "note", "reach", "resolution_events"]
