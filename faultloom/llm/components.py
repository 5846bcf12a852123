"""Consolidating pairwise matches into groups.

The giant component is peeled first: breadth-first frontier joins from the vertex of highest
degree take most of it in a few rounds, as its diameter is small. It is then removed by anti-join
and the many small components that remain are labelled by minimum propagation. Frontiers that
dwindle into long tails are not chased one join per step: the visited part is contracted to one
vertex and its tail goes to the propagation, which shortens paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.text import utrim
from faultloom.operators.components import min_label_components
from faultloom.session import Scratch

SALTS = 16


def peel_giant(edges: DataFrame, scratch: Scratch, tail: float = 0.125, max_rounds: int = 24) -> tuple[int | None, DataFrame | None, DataFrame]:
    """``(start, visited (vertex), rest)`` over symmetric ``edges (u, v)``.

    Frontiers are followed until they are empty or smaller than ``tail`` of what was visited. In
    ``rest`` visited ends are contracted to ``start``; edges inside the visited part are gone.
    """
    top = edges.groupBy("u").count().agg(F.max_by("u", F.struct("count", -F.col("u"))).alias("u")).first()
    if top is None or top.u is None:
        return None, None, edges
    start = int(top.u)
    spark = edges.sparkSession
    levels = [scratch.save(spark.range(1).select(F.lit(start).cast("long").alias("vertex")))]
    seen = 1
    for _ in range(max_rounds):
        frontier = levels[-1]
        reached = edges.join(frontier.withColumnRenamed("vertex", "u"), "u", "left_semi").select(F.col("v").alias("vertex")).distinct()
        # neighbours of level i lie in the levels i-1, i and i+1 only
        for old in levels[-2:]:
            reached = reached.join(old, "vertex", "left_anti")
        nxt, seen_now = scratch.save_with(reached, n=F.count(F.lit(1)))
        n = seen_now["n"]
        if not n:
            break
        levels.append(nxt)
        seen += n
        if n < tail * seen:
            break
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.union(level)
    inside = visited.withColumn("inside", F.lit(True))
    outer = edges.join(visited.withColumnRenamed("vertex", "u"), "u", "left_anti")
    rest = outer.join(inside.withColumnRenamed("vertex", "v"), "v", "left").select("u", F.when(F.col("inside"), F.lit(start)).otherwise(F.col("v")).alias("v"))
    return start, visited, rest


def connected_groups(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges (u long, v long)``.

    ``component`` is some vertex of the component, the same for all of it. Loops, repeats and
    either direction of an edge change nothing; null ends are dropped; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    plain = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    both = scratch.save(plain.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    start, visited, rest = peel_giant(both.where("u <> v"), scratch)
    labels = scratch.save(min_label_components(rest, scratch))
    if visited is None:
        tops = labels
    else:
        of_start = labels.where(F.col("vertex") == start).agg(F.max("component")).first()[0]
        tops = labels.where(F.col("vertex") != start).union(visited.select("vertex", F.lit(start if of_start is None else of_start).cast("long").alias("component")))
    alone = both.where("u = v").select(F.col("u").alias("vertex")).join(tops, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return tops.union(alone)


def salted(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """``big LEFT JOIN small`` on ``key``, a key's rows dealt over ``salts`` tasks by ``by``.

    ``small`` has one row a key and is repeated ``salts`` times, so the hottest key of ``big``
    makes no task larger than a share of it.
    """
    dealt = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(dealt, [key, "salt"], "left").drop("salt")


def match_groups(rows: DataFrame, pairs: DataFrame, row_id: str = "id", key: str = "fingerprint", left: str = "left_ref", right: str = "right_ref", verdict: str = "verdict") -> DataFrame:
    """``(id, group_id)``: every row in a group of two or more rows, with the group's smallest id.

    A reference is a row id in decimal as the number is written (any bigint; other spellings such
    as leading zeros name no row), or a key (it contains ``:``) that stands for all rows carrying
    it and links them to each other and to the other side. Pairs count if the verdict is ``match``
    in any letter case and both references are present once trimmed; repeats, either direction and
    self pairs change nothing, except that a key paired with itself still links its rows.
    References to unknown rows or keys link what refers to them but are not put out. Rows with a
    null id are left out, rows with a null key are reached by id only; repeated rows come out
    once; other columns are not read. Empty tables give no rows.

    The vertices of the graph are the references themselves, numbered once, so the graph has the
    size of the pairs; rows meet it in two joins, by id and, salted, by key.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    rows = rows.select(F.col(row_id).cast("long").alias("id"), F.col(key).cast("string").alias("fp")).where("id IS NOT NULL")
    refs = pairs.where(F.lower(utrim(verdict)) == "match").select(F.nullif(utrim(left), F.lit("")).alias("l"), F.nullif(utrim(right), F.lit("")).alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    refs = scratch.save(refs.distinct())
    names = scratch.save(refs.select(F.explode(F.array("l", "r")).alias("ref")).distinct().withColumn("vertex", F.monotonically_increasing_id()))
    is_key = F.contains("ref", F.lit(":"))
    as_id = F.expr("try_cast(ref as bigint)")
    keyed = names.where(is_key).select(F.col("ref").alias("fp"), F.col("vertex").alias("kv"))
    named = names.where(~is_key & (as_id.cast("string") == F.col("ref"))).select(as_id.alias("id"), F.col("vertex").alias("iv"))
    # what each row is referred to by: nothing, its id, its key or both
    placed = scratch.save(salted(rows.join(named, "id", "left"), keyed, "fp", "id").where("iv IS NOT NULL OR kv IS NOT NULL").select("id", "iv", "kv").distinct())
    edges = refs.join(names.select(F.col("ref").alias("l"), F.col("vertex").alias("u")), "l").join(names.select(F.col("ref").alias("r"), F.col("vertex").alias("v")), "r").select("u", "v")
    both = placed.where("iv IS NOT NULL AND kv IS NOT NULL").select(F.col("iv").alias("u"), F.col("kv").alias("v"))
    comp = scratch.save(connected_groups(edges.union(both), scratch))
    # rows are folded by their vertex before they are folded by component
    own = F.coalesce("kv", "iv").alias("vertex")
    folded = scratch.save(placed.groupBy(own).agg(F.min("id").alias("low"), F.count("*").alias("n")).join(comp, "vertex"))
    groups = folded.groupBy("component").agg(F.min("low").alias("group_id"), F.sum("n").alias("n")).where("n > 1").drop("n")
    group_of = salted(folded.select("vertex", "component"), groups, "component", "vertex").where("group_id IS NOT NULL").select("vertex", "group_id")
    return salted(placed.select("id", own), group_of, "vertex", "id").where("group_id IS NOT NULL").select("id", "group_id").distinct()
