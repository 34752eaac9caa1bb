"""Where rows go: tables, dumps and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.describe import or_dashes, thousands


def save(df: DataFrame, path: str, *, bucket: str | None = None) -> None:
    """Rewrite a table, which ``df`` may have been read from; sorted within files by ``bucket`` so that lookups by it
    skip row groups. The new files are written beside the old ones, and take their place when all are there."""
    spark = df.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    (df.sortWithinPartitions(bucket) if bucket else df).write.parquet(staged)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{staged} can't take the place of {path}")
    spark.catalog.refreshByPath(path)


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def route_table(pairs: DataFrame) -> DataFrame:
    """Origin, Destination, Distance of each jump, as printed. ``pairs``: hop, origin, destination, leg."""
    return pairs.orderBy("hop").select(F.col("origin").alias("Origin"), F.col("destination").alias("Destination"), F.format_string("%.2f Ly", "leg").alias("Distance"))


def route_summary(report: DataFrame) -> DataFrame:
    """The line under a route's table. ``report``: jumps, path, straight."""
    return report.select(F.format_string("jumps: %.2f, path: %.2f Ly, distance: %.2f Ly", F.col("jumps").cast("double"), "path", "straight").alias("summary"))


def record(systems: DataFrame) -> DataFrame:
    """Lines said of each system: only what is known, population only above none."""
    said = [
        F.concat(F.lit("Name: "), "name"),
        F.when(F.col("population") > 0, F.concat(F.lit("Population: "), thousands(F.col("population")))),
        *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.title()}: "), F.col(c))) for c in ("security", "government", "allegiance")],
    ]
    return systems.select("address", F.array_join(F.array_compact(F.array(*said)), "\n").alias("text"))


def page(df: DataFrame) -> DataFrame:
    """Every column as a page shows it."""
    return df.select([or_dashes(F.col(c)).alias(c) for c in df.columns])


def sizes(spark: SparkSession, folder: str, names: list[str], skip: tuple[str, ...] = ("systems",)) -> list[tuple[str, int]]:
    """Bytes of each table's files, largest first, by the session's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for n in names:
        if n not in skip:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
            out.append((n, path.getFileSystem(conf).getContentSummary(path).getLength()))
    return sorted(out, key=lambda x: (-x[1], x[0]))
