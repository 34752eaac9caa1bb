"""Operator 4, mixing sources to target weights: a time-varying curriculum. DataFrame functions only.

A source's documents lie end to end, in the order of their ids' MD5, on a line of its words. The source's demand for
words over training time is its weight schedule, integrated and scaled to its target. Inverting
that demand at a document's mark on the line gives the position in training at which the document
is due; where the target exceeds the source, the line is laid again, up to three times. Documents
are then range-sorted by position.

The mark is a prefix sum over a source that may hold a third of all rows, so it is made in blocks:
rows of a block, a range of the order, are summed by one task, and only sums of blocks are summed further.

Edge cases: a null text or one without words has size 0 and is never taken; a very long text may be cut
by its source's target, and is then counted with the words taken; a null source is a source, last in
order; rows with equal ids go by size; repeated rows each take their own stretch of the line; an empty table gives
an empty result; other columns of the input are ignored or, in ``mixed``, passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Knots (training time, relative weight) of each weight's schedule: the heaviest sources early, the lightest late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def invert(schedule: tuple, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of the schedule's integral has passed."""
    area, segments = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        segments.append((area, t0, w0, (w1 - w0) / (t1 - t0)))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for start, t0, w0, slope in segments:
        left = share * area - start
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + left * (2 * slope), F.lit(0.0)))
        at = F.lit(t0) + F.when(left <= 0, F.lit(0.0)).otherwise(left * 2 / (root + w0))
        out = at if out is None else F.when(share * area >= start, at).otherwise(out)
    return F.least(out, F.lit(schedule[-1][0]))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: its rank's weight and target. ``sizes``: source_key, source, source_size, one row a source.

    Water filling in closed form: with sources by rising cap per weight, the first whose share of what
    the earlier, capped ones leave stays below its own cap gives the level for it and all later ones.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.select("*", rank.alias("rank"), weight.cast("long").alias("weight"), (F.col("source_size") * MAX_REPEATS).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - capped) / weights)
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.withColumn("level", F.min(holds).over(every)["level"]).select(
        "source_key", "source_size", "rank", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target")
    )


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more,
    )


def curriculum(items: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """``items`` (of ``sized``) with source_size, target and ``uses``, an array of (words, position)
    with one entry for each time the mix takes the document."""
    rows = items.count()
    blocks = max(1, math.isqrt(rows))  # as many blocks as rows to a block: neither sum meets more
    items = items.select("*", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("mark"))
    # a block is a range of marks, so blocks end to end are in the order of marks
    items = items.withColumn("block", F.shiftright(F.conv(F.left("mark", F.lit(8)), 16, 10).cast("long") * blocks, 32))
    sums = items.groupBy("source_key", "block").agg(F.first("source").alias("source"), F.sum("size").alias("block_size"))
    sources = targets(sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("block_size").alias("source_size")))
    by_block = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("source_key", "block", F.coalesce(F.sum("block_size").over(by_block), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("source_key", "block").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = items.withColumn("end", F.sum("size").over(inside)).join(start.join(sources, "source_key"), ["source_key", "block"])
    begin = F.col("block_start") + F.col("end") - F.col("size")
    wanted = F.round("target").cast("long")
    uses = []
    for k in range(MAX_REPEATS):
        at = begin + F.col("source_size") * k
        words = F.greatest(F.least(wanted - at, F.col("size")), F.lit(0).cast("long"))
        share = F.least(at / F.greatest(wanted, F.lit(1)), F.lit(1.0))
        position = None
        for i, schedule in enumerate(schedules):
            time = invert(schedule, share)
            position = time if position is None else F.when(F.col("rank") % len(schedules) == i, time).otherwise(position)
        uses.append(F.struct(words.alias("words"), position.alias("position")))
    return laid.withColumn("uses", F.filter(F.array(*uses), lambda u: u["words"] > 0))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    first = F.get(F.col("uses"), F.lit(0))["position"]
    return (
        curriculum(durable(sized(table(spark, sf_dir, "documents"))))
        .select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))
        .orderBy("first_position", "doc_id")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: a whole row of ``docs`` for each use of at least half its words, in training order."""
    plan = curriculum(sized(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row")))
    use = plan.select("row", F.col("size").alias("size"), F.explode("uses").alias("use"))
    return use.filter(F.col("use.words") * 2 >= F.col("size")).orderBy("use.position", "row.doc_id").select("row.*")
