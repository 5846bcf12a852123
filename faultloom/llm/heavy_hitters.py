"""Most frequent items in bounded memory: Misra-Gries summaries per partition, merged.

Every partition folds its rows into at most ``k`` counters. A summary that outgrows ``k`` is cut
by subtracting its (k+1)-th largest counter from all others, which lowers any true count by at
most n/(k+1) over n rows; merged summaries keep that bound. So each value carried by more than
n/(k+1) rows survives every merge, wherever its rows lie, and an exact recount of the at most
``k`` survivors makes the counts true.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.session import Scratch, spread


def shrink(counts: dict, k: int) -> dict:
    """Misra-Gries cut: subtract the (k+1)-th largest counter, keep what stays positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {v: c - cut for v, c in counts.items() if c > cut}


def merge(into: dict, values: list, counts: list, k: int) -> dict:
    get = into.get
    for v, c in zip(values, counts):
        into[v] = get(v, 0) + c
    return shrink(into, k)


def _fold(k: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict = {}
        n, schema = 0, None
        for b in batches:
            schema = b.schema
            if weighted:
                n += pc.sum(b.column("rows")).as_py() or 0
                keep = b.filter(pc.is_valid(b.column("item")))
                # step by step, so memory stays at k plus one step however many counters arrive
                for at in range(0, keep.num_rows, k):
                    s = keep.slice(at, k)
                    summary = merge(summary, s.column("item").to_pylist(), s.column("count").to_pylist(), k)
            else:
                n += b.num_rows
                vc = pc.value_counts(b.column(0).drop_null())
                summary = merge(summary, vc.field("values").to_pylist(), vc.field("counts").to_pylist(), k)
        if schema is not None:
            t = schema.field(0).type
            items, counts = list(summary), list(summary.values())
            yield pa.RecordBatch.from_arrays(
                # one row without an item carries the number of rows seen
                [pa.array([None, *items], t), pa.array([0, *counts], pa.int64()), pa.array([n] + [0] * len(items), pa.int64())],
                names=["item", "count", "rows"],
            )

    return run


def misra_gries(df: DataFrame, column: str, k: int, fan_in: int = 64) -> DataFrame:
    """Summary of ``column``: rows ``(item, count, rows)``, at most ``k`` items.

    ``count`` is a lower bound, too low by at most n/(k+1). The row with a null item holds in
    ``rows`` the number n of input rows; nulls in ``column`` count as rows but never as items.
    An empty input gives no rows. Every split is folded by its own task; partial summaries meet
    in a tree of ``fan_in``, and what is shuffled is k counters a partition, never the rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    one = spread(df.select(F.col(column).alias("item")))
    schema = T.StructType([T.StructField("item", one.schema[0].dataType), T.StructField("count", T.LongType()), T.StructField("rows", T.LongType())])
    partial = one.mapInArrow(_fold(k, False), schema)
    parts = one.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        partial = partial.repartition(parts).mapInArrow(_fold(k, True), schema)
    return partial


def frequent_items(df: DataFrame, column: str, support: float, k: int | None = None, exact: bool = True, fan_in: int = 64) -> DataFrame:
    """``(item, n_rows, at_least)``: every value carried by at least ``support`` of all rows.

    ``at_least`` is the summary's lower bound. With ``exact`` the survivors are recounted in a
    second scan and only those that truly reach the support stay, so there are no false items;
    without it all survivors that may reach it come out and ``n_rows`` is the upper bound.
    ``k`` defaults to twice 1/support, which halves the error. Nulls are rows but no item; ties
    at the threshold are all kept; an empty table gives no rows; other columns are not read.
    """
    if not 0 < support <= 1:
        raise ValueError("support must lie in (0, 1]")
    k = k or int(2 / support) + 1
    s = Scratch(df.sparkSession).save(misra_gries(df, column, k, fan_in))  # at most k + 1 rows, taken once
    total = s.agg(F.sum("rows")).first()[0] or 0
    share = Fraction(str(support))
    error, least = total // (k + 1), -(-share.numerator * total // share.denominator)  # whole numbers, no rounding
    s = s.where(F.col("item").isNotNull() & (F.col("count") + error >= least))
    if not exact:
        return s.select("item", (F.col("count") + error).cast("long").alias("n_rows"), F.col("count").alias("at_least"))
    # at most k survivors, a bound that does not depend on the data
    hits = df.select(F.col(column).alias("item")).join(F.broadcast(s.select("item")), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n_rows"))
    return hits.where(F.col("n_rows") >= least).join(F.broadcast(s), "item").select("item", "n_rows", F.col("count").alias("at_least"))
