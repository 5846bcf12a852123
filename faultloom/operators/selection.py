"""Failures that a test selection left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.text import same_commit, test_name, utrim, without_arguments
from faultloom.operators.stats import test_stats


def candidates(f: DataFrame) -> DataFrame:
    """Names under which a failure may stand in a selection, best first."""
    method = F.when((F.col("classname") != "") & (F.col("method") != ""), F.concat_ws(".", "classname", "method"))
    names = F.array_distinct(F.transform(F.array_compact(F.array("full_name", "name", method)), lambda x: without_arguments(x)))
    return f.select("seq", F.posexplode(names).alias("pos", "test"))


def misses(failures: DataFrame, skipped: DataFrame, projects: DataFrame) -> DataFrame:
    """``(seq, test, project, how, n_candidates)`` for failures that were skipped or may have been.

    ``failures`` have a unique ``seq``; ``skipped (test, project)`` has unique tests; ``projects
    (project, assembly)``. A failure in an assembly skipped whole counts as ``project``; else the
    first candidate name that was skipped, as ``exact``; else, unless class and method are both
    known, the only skipped test that ends with its name, as ``suffix``. Several such tests make
    it ``ambiguous``. Suffixes are joined on the last dotted part, never by comparing all pairs;
    a name that itself holds dots is compared in full after that join.
    """
    whole = projects.where("assembly IS NOT NULL").groupBy(F.lower("assembly").alias("a")).agg(F.min("project").alias("whole"))
    f = failures.join(whole, F.lower(failures.assembly) == F.col("a"), "left").drop("a")
    by_project = f.where("whole IS NOT NULL").select("seq", without_arguments("full_name").alias("test"), F.col("whole").alias("project"), F.lit("project").alias("how"), F.lit(1).cast("long").alias("n_candidates"))
    rest = f.where("whole IS NULL")
    exact = candidates(rest).join(skipped, "test").groupBy("seq").agg(F.min_by(F.struct("test", "project"), "pos").alias("b")).select("seq", "b.test", "b.project", F.lit("exact").alias("how"), F.lit(1).cast("long").alias("n_candidates"))
    open_ = rest.join(exact.select("seq"), "seq", "left_anti").where(~(F.col("method").isNotNull() & (F.coalesce(utrim("classname"), F.lit("")) != "")))
    named = open_.select("seq", without_arguments(F.when(F.col("method") != "", F.col("method")).otherwise(F.col("name"))).alias("suffix")).where("suffix <> ''")
    last = lambda c: F.substring_index(c, ".", -1)
    hit = named.withColumn("last", last("suffix")).join(skipped.withColumn("last", last("test")), "last").where(F.endswith("test", F.concat(F.lit("."), F.col("suffix"))))
    by_suffix = hit.groupBy("seq").agg(F.count("*").alias("n_candidates"), F.min("test").alias("test"), F.min_by("project", "test").alias("project")).select(
        "seq", F.when(F.col("n_candidates") == 1, F.col("test")).alias("test"), F.when(F.col("n_candidates") == 1, F.col("project")).alias("project"), F.when(F.col("n_candidates") == 1, "suffix").otherwise("ambiguous").alias("how"), "n_candidates"
    )
    return by_project.unionByName(exact).unionByName(by_suffix)


def first_reports(found: DataFrame, failures: DataFrame) -> DataFrame:
    """Each missed test once, and each ambiguous failure once: the first in input order."""
    key = F.coalesce("test", F.concat(F.lit("?"), F.col("full_name")))
    x = found.join(failures.select("seq", "full_name"), "seq").withColumn("key", key)
    first = x.groupBy("key").agg(F.min("seq").alias("seq"))
    return x.join(first, ["key", "seq"], "left_semi").drop("key", "full_name")


def with_history(missed: DataFrame, failures: DataFrame, h: DataFrame, repo: str | None = None, commit: str | None = None) -> DataFrame:
    """Missed tests with their earlier failures, likely misses (never failed before) first."""
    rows = h
    if repo is not None:
        rows = rows.where(F.col("repo_id").isNull() | (F.col("repo_id") == repo))
    if commit is not None:
        rows = rows.where(~same_commit("git_commit", F.lit(commit)))
    rows = rows.withColumn("test", without_arguments(test_name("source"))).where("test IS NOT NULL")
    stat = test_stats(rows).select("test", "failures", "last_seen")
    own = failures.select("seq", without_arguments("full_name").alias("full"))
    x = missed.join(own, "seq").join(stat.select("test", F.struct("failures", "last_seen").alias("s1")), "test", "left").join(stat.select(F.col("test").alias("full"), F.struct("failures", "last_seen").alias("s2")), "full", "left")
    s = F.coalesce("s1", "s2")
    return x.select("seq", "test", "project", "how", F.coalesce(s["failures"], F.lit(0)).alias("failures"), s["last_seen"].alias("last_seen")).orderBy("failures", "seq")


def unchecked_projects(failures: DataFrame, found: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects skipped whole of which nothing can be said."""
    loose = failures.where("assembly IS NULL").join(found.select("seq"), "seq", "left_anti").count()
    x = projects.withColumn("n", F.lit(loose))
    return x.where("assembly IS NULL OR n > 0").select("project", F.when(F.col("assembly").isNull(), "no assembly named").otherwise(F.concat(F.col("n").cast("string"), F.lit(" failing tests name no assembly"))).alias("reason"))


