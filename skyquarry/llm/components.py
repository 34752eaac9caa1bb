"""Connected components of a table of links, by alternating large and small stars.

Every round hangs each node's neighbours on the smallest node of its neighbourhood, first the larger
neighbours, then the smaller ones; the links end as stars around the smallest node of each
component after about log rounds. Nodes never leave the executors, and each round's links are cut
off from the last by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _hang(links: DataFrame, larger: bool) -> DataFrame:
    if larger:  # every node, with its larger neighbours
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # the larger end of every link, with its smaller neighbours
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    met = both.join(least, "a")
    if larger:
        return met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a != b").distinct()
    up = met.select(F.col("b").alias("a"), F.col("root").alias("b"))
    return up.union(least.select("a", F.col("root").alias("b"))).filter("a != b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """a, b: every node of ``links`` (a, b) that isn't the smallest of its component, and that one."""
    links = durable(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    last = None
    while True:
        links = durable(_hang(_hang(links, True), False))
        now = tuple(links.agg(F.count(F.lit(1)), sign).first())
        if now == last:
            return links
        last = now
