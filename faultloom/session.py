"""Session helpers: table access, reliable materialisation, input spreading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only in local mode is a private folder made and set where the setting is absent.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="faultloom-")
        sc.setCheckpointDir(path)  # so the next call finds the same one
    return path


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    Writing cuts the lineage and survives the loss of any executor; the planner then sees real
    sizes, so it broadcasts a side only when that side is proven small. ``drop`` frees a table
    as soon as an iteration no longer needs it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/faultloom-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def save_with(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """Save and take aggregates over the rows in the same pass."""
        seen = Observation()
        out = self.save(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
        return out, seen.get

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = self._paths.pop(id(df), None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        """Delete everything; runs at the end of the program, as results may read these tables."""
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy narrow operators at least one partition per core.

    Inputs of many splits pass through unchanged, so nothing is shuffled at scale; only an input
    smaller than the cluster (one file, one row group) is dealt out.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= want else df.repartition(want)
