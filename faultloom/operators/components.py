"""Connected components by minimum labels with star contraction.

Each round replaces edges by links towards the smallest neighbour (large star, then small star),
so a path of length d shrinks in O(log d) rounds instead of d. Before that every task contracts
what it holds, a bounded number of edges at a time, to links towards the smallest vertex reached
within them; nothing is shuffled for it and rounds become fewer. Edges never outgrow the input.
Hubs: minima are combined before they are shuffled, and the join with a hub's neighbours is cut by
adaptive execution as any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.session import Scratch


CONTRACT_EDGES = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every vertex of the edges to the smallest one it reaches, itself left out."""
    names, at = np.unique(np.append(u, v), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def links() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = contracted(t.column("u").to_numpy(), t.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CONTRACT_EDGES:
            yield links()
            held = []
    if held:
        yield links()


def contract(edges: DataFrame) -> DataFrame:
    """Edges ``(u long, v long)`` contracted within each task; what they connect stays connected."""
    return edges.mapInArrow(_contract, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every edge points from the larger end ``u`` to the smaller ``v``."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


#: a table's size and the sum of its rows' hashes
_STATE = {"n": "count(1)", "mark": "sum(cast(xxhash64(u, v) as decimal(38,0)))"}


def min_label_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges (u long, v long)``.

    ``component`` is the smallest vertex. Loops and repeated edges change nothing (a vertex with
    loops only is its own component); null ends are dropped; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e0 = scratch.save(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL").distinct())
    state = {k: F.expr(x) for k, x in _STATE.items()}
    e, before = scratch.save_with(e0.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **state)
    for _ in range(max_rounds if before["n"] else 0):
        nxt, now = scratch.save_with(_small_star(_large_star(contract(e))), **state)
        scratch.drop(e)
        e = nxt
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError("components did not settle")
    vertices = e0.select(F.col("u").alias("vertex")).union(e0.select("v")).distinct()
    return vertices.join(e.select(F.col("u").alias("vertex"), F.col("v").alias("component")), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
