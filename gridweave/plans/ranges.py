"""Cuts in lineage, and ranks over a whole table without sending it to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage by a table in spark.checkpoint.dir.

    Where the session names no such folder, a temporary one is set if it runs on this machine alone. A table also forgets what the
    optimiser has derived about the rows, which DataFrame.checkpoint() hands on from round to round.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of the rounds of an iteration: when a round's is written, the one before it is removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        """df as a table, in place of the one before, which df may read."""
        path, before = shared_folder(self.spark, "round"), self.path
        df.write.parquet(path)
        self.path = path
        if before is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over all rows up to each one, in an order over the whole table.

    Rows are dealt into ranges of the order and summed there; the totals of earlier ranges, one row each, are
    added on. The ranges are kept, since another run might cut them elsewhere. Rows that are equal in the order
    must be told apart by its later columns, or may be numbered either way.
    """
    parts = checkpointed(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("_v").alias("_own"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_local", F.sum("_v").over(inside)).join(carried, "_part")
    return local.withColumn(out, F.col("_local") + F.col("_carry")).drop("_part", "_v", "_local", "_carry")
