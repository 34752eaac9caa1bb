"""Cuts of lineage that outlive executors, and numbers over rows dealt by ranges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint, in the folder the session names; a temporary one only in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyquarry-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order: ranges are sorted apart, and each goes on from
    the rows of those before. Another sample would give other ranges, so they are kept."""
    sorted_ = df.withColumn("_at", order).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")
    ranged = cut(sorted_.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.min("_nth").alias("least"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", (before - F.col("least")).alias("_start")))  # a row for each partition
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_nth")).drop("_range", "_nth", "_start")
