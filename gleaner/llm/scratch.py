"""Intermediate tables in the shared checkpoint folder.

A written table cuts the lineage: a lost executor costs the tasks it ran, not the
stages before the table. The folder is the one the cluster names in
``spark.checkpoint.dir`` (``gleaner.session.checkpoint_dir``), which driver and
executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir


class Scratch:
    """Tables of one operator call, each under a name of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(conf).delete(path, True)


def ship(df: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """``df`` marked for broadcast if it is proven small, else as it is.

    For narrow rows (an id or two) only: ``max_rows`` of them stay under 64 MB. Beyond
    that the join it takes part in shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
