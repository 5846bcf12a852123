"""Ordered per-key results in balanced work, however few keys hold most rows.

Rows are range-partitioned by (key, order) with quantiles that Spark samples from the data, so a
key that holds a third of the rows is cut over a third of the partitions. Each partition is
scanned in order, column-wise; only its first row lacks its predecessor, which a second, tiny
pass over one boundary row per partition supplies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.session import Scratch

_OUT = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType())]
)


def _scan(gap_us: int):
    """Emit a partition's own cases (edge 0), its first row (1) and its last row (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "value", "id", "at", "part", "edge"]
        last = None
        part = None

        def out(b: pa.RecordBatch, edge: int) -> pa.RecordBatch:
            cols = [b.column(c) for c in names[:5]] + [pa.array(np.full(b.num_rows, edge, np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                yield out(b.slice(0, 1), 1)
            else:
                b = pa.concat_tables([pa.Table.from_batches([last]), pa.Table.from_batches([b])]).combine_chunks().to_batches()[0]
            at = b.column("at").to_numpy(zero_copy_only=False)
            late = np.diff(at) > gap_us
            if late.any():
                cur, old = b.slice(1), b.slice(0, b.num_rows - 1)
                same = pc.and_(pc.equal(cur.column("kind"), old.column("kind")), pc.equal(cur.column("value"), old.column("value")))
                hit = pc.and_(same, pa.array(late))
                if pc.any(hit).as_py():
                    yield out(cur.filter(hit), 0)
            last = b.slice(b.num_rows - 1, 1)
        if last is not None:
            yield out(last, 2)

    return run


def reappearances(df: DataFrame, keys: dict[str, str], time: str, row_id: str, silence_seconds: int, partitions: int | None = None) -> DataFrame:
    """``(key_kind, key_value, id)``: rows whose predecessor of the same key value, in order of
    ``time`` then ``row_id``, is more than ``silence_seconds`` earlier.

    ``keys`` maps a kind's name to its column; all kinds share one pass. A value's first row is
    no case. Rows with a null key, time or id have no place in the order and are left out; equal
    times follow the id; repeated rows stand at distance zero; an empty table gives no rows.
    Other columns are never read, whatever their names.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in keys.items()])
    rows = (
        df.select(F.col(row_id).cast("long").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.explode(kinds).alias("k"))
        .select("k.kind", "k.value", "id", "at")
        .where(F.col("value").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull())
    )
    order = ["kind", "value", "at", "id"]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    scanned = Scratch(df.sparkSession).save(ranged.mapInArrow(_scan(silence_seconds * 1_000_000), _OUT))
    # two rows a partition: the order of partitions is the order of keys
    w = Window.orderBy("part", "edge")
    edges = scanned.where("edge > 0").select("*", F.lag(F.struct("kind", "value", "at")).over(w).alias("p"))
    stitched = edges.where((F.col("edge") == 1) & (F.col("p.kind") == F.col("kind")) & (F.col("p.value") == F.col("value")) & (F.col("at") - F.col("p.at") > silence_seconds * 1_000_000))
    out = [F.col("kind").alias("key_kind"), F.col("value").alias("key_value"), "id"]
    return scanned.where("edge = 0").select(*out).unionByName(stitched.select(*out))
