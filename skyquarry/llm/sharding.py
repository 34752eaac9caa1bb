"""Operator 1, sharding: vector bin packing of bytes, tokens and rows.

Equal texts form a group, and a group goes to one shard. Every group is a vector of its shares of
all bytes, tokens and rows; groups are placed largest first, each on the shard where the dot
product of the vector with the shard's residual capacity is highest.

The driver packs a bounded number of vectors whatever the input: groups above 1/(64 * shards) of any
total (at most 3 * 64 * shards of them) are placed singly, and all smaller ones are first hashed
into a fixed number of cells, which are placed as wholes. A group above the capacity of a shard,
such as a text that a third of all rows repeat, is split by doc_id into as few pieces as fit.

Edge cases: a null text has size 16, no tokens and a null checksum, and null texts are one group;
an empty text is another; a very long text, even above a shard's share, is one vector and goes whole to
one shard; groups of equal vectors are placed in the order of their digests, and slots go by doc_id;
repeated rows keep one row each and get slots of their own; an empty table gives an empty result; other
columns of the input are ignored, or in ``sharded`` passed on, but for columns named shard and slot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

DIMENSIONS = ("bytes", "tokens", "rows")
#: How much each dimension counts in the dot product; bytes most, as the law that holds is that of bytes.
WEIGHTS = (4.0, 1.0, 1.0)
#: A group above this part of one shard is placed by itself.
FINE = 64
CELLS = 8192
#: Rows of one shard that one task numbers.
SLOT_ROWS = 4096


def digest(docs: DataFrame, *more: Column) -> DataFrame:
    """Per row: what packing needs to know of the text, so that the text is read once."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"null")).alias("group"),
        *more,
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (columns: shares of the totals), by the dot-product rule."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0)))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in order:
        at = int(np.argmax(residual @ (vectors[i] * WEIGHTS)))
        residual[at] -= vectors[i]
        out[i] = at
    return out


def _sums() -> list:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]


def planned(items: DataFrame, shards: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What gives ``items`` (doc_id, size, tokens, group, ...) their ``shard``, and how many they are."""
    spark = items.sparkSession
    total = items.agg(*_sums()).first()
    full = [max(1, total[d] or 0) for d in DIMENSIONS]
    groups = items.groupBy("group").agg(*_sums())
    share = F.greatest(*[F.col(d) / F.lit(float(x)) for d, x in zip(DIMENSIONS, full)])
    large = share > 1.0 / (shards * FINE)
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS)).cast("int")
    # at most 3 * FINE * shards large groups and CELLS cells: bounded for any input
    found = (
        groups.groupBy(F.when(large, F.col("group")).alias("group"), F.when(~large, cell).alias("cell"))
        .agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
        .collect()
    )
    found.sort(key=lambda r: (r["group"] is None, bytes(r["group"] or b""), r["cell"] or 0))
    pieces = {}
    for r in found:
        n = math.ceil(max(r[d] / x for d, x in zip(DIMENSIONS, full)) * shards - 1e-9)
        if r["group"] is not None and n > 1:
            pieces[bytes(r["group"])] = n
    rows = [(None if r["group"] is None else bytes(r["group"]), 1, 0, r["cell"], *(r[d] for d in DIMENSIONS)) for r in found]
    if pieces:  # at most 3 * shards such groups, and twice as many pieces
        heavy = F.broadcast(spark.createDataFrame([(bytearray(g), n) for g, n in pieces.items()], "group binary, pieces int"))
        parts = items.join(heavy, "group").groupBy("group", "pieces", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int").alias("piece")).agg(*_sums()).collect()
        rows = [r for r in rows if r[0] not in pieces] + sorted((bytes(r["group"]), r["pieces"], r["piece"], None, *(r[d] for d in DIMENSIONS)) for r in parts)
    vectors = np.array([r[4:] for r in rows], dtype=float).reshape(len(rows), 3) / full
    where = place(vectors, shards)
    single = [(bytearray(r[0]), r[1], r[2], int(s)) for r, s in zip(rows, where) if r[0] is not None]
    cells = [(r[3], int(s)) for r, s in zip(rows, where) if r[0] is None]
    single = F.broadcast(spark.createDataFrame(single, "group binary, of int, piece int, single_shard int"))
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, cell_shard int"))
    piece = F.pmod(F.xxhash64("i.doc_id"), F.col("s.of")).cast("int")

    def placed(some: DataFrame) -> DataFrame:
        with_single = some.alias("i").join(single.alias("s"), (F.col("i.group") == F.col("s.group")) & (piece == F.col("s.piece")), "left")
        with_both = with_single.join(cells.alias("c"), F.pmod(F.xxhash64("i.group"), F.lit(CELLS)).cast("int") == F.col("c.cell"), "left")
        return with_both.select("i.*", F.coalesce("single_shard", "cell_shard").alias("shard"))

    return placed, total["rows"]


def number(items: DataFrame, shards: int, rows: int) -> DataFrame:
    """``slot``: gapless from 0 in each shard. Shards are numbered in blocks, so no task holds one."""
    blocks = max(1, math.ceil(rows / (shards * SLOT_ROWS)))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "group")).cast("long") - 1
    if blocks == 1:
        return items.withColumn("slot", inside).drop("block")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = items.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return items.withColumn("slot", inside).join(start, ["shard", "block"]).withColumn("slot", F.col("slot") + F.col("start")).drop("block", "start")


def vector_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, tokens, group, shard, slot of every row of ``docs``."""
    items = durable(digest(docs))
    placed, rows = planned(items, shards)
    return number(placed(items), shards, rows)


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The rows of ``docs`` with shard and slot, in place of columns of these names; texts are shuffled once, to their shards."""
    placed, rows = planned(durable(digest(docs)), shards)
    items = placed(digest(docs, F.struct(*[F.col(c) for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("row")))
    return number(items, shards, rows).select("row.*", "shard", "slot")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
