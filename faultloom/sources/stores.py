"""History stores: Parquet natively, relational databases by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("analyzed_at", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("source", "ecosystem", "rule_id")]
    + [T.StructField("matched", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("fingerprint", "log_hash", "excerpt")]
    + [T.StructField("tokens", T.MapType(T.StringType(), T.IntegerType())), T.StructField("resolution", T.StringType()), T.StructField("resolved_at", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("resolution_source", "resolved_commit", "repo_id", "git_commit", "git_branch")]
    + [T.StructField("git_dirty", T.BooleanType()), T.StructField("status", T.StringType())]
)


def open_history(spark: SparkSession, path: str) -> DataFrame:
    """The table under one schema; columns that older files lack are null."""
    return spark.read.schema(HISTORY).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Files by day, so time filters prune and no day waits for another."""
    df.withColumn("day", F.to_date("analyzed_at")).write.mode("append").partitionBy("day").parquet(path)


def open_jdbc(spark: SparkSession, url: str, dbtable: str = "analyses", lower: int | None = None, upper: int | None = None, parts: int = 16, **options: str) -> DataFrame:
    """Read over JDBC, split by id if bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if lower is not None and upper is not None:
        r = r.option("partitionColumn", "id").option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


REGISTRY = {"parquet": open_history, **{k: open_jdbc for k in ("sqlite", "postgres", "mysql", "sqlserver")}}


def opener(name: str):
    if name.lower() not in REGISTRY:
        raise KeyError(f"unknown store {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name.lower()]
