"""Operator 10, near duplicates: MinHash with tensored banding, verified on whole shingle sets.

Two small collections of band keys are made from few minhashes each, TABLES keys of ROWS minhashes
in either; a table of the index is a pair of one key from each collection, so 2 * TABLES * ROWS
minhashes serve TABLES ** 2 tables. Documents whose keys of either collection all stand alone are
in no table with another and drop out before the pairs are formed.

Documents with equal shingle sets are one node, found by two independent 64-bit sums over the set,
so copies cost one row. In each table every node is compared with one hub, so groups of near copies
cost a row for each member and not for each pair. Nodes in tables that then still hold different
components are compared across components by prefix: with shingles ordered from rare to common,
sets as similar as asked share one among their first few, at ranks that leave room for the
intersection. A member far from the others starts with shingles of its own and meets nobody. So no
link between nodes that meet in a table is missed; one of similarity s meets in none with
probability 2 * (1 - s ** ROWS) ** TABLES or less: 1 in 100,000 at 0.8.

Edge cases: null, empty and wordless texts have an empty set and are linked with nothing; a text
with fewer words than a shingle has its whole sequence as its one shingle; a very long text is read
whole, and its rows grow with its words (each carries FIRST shingles, however many the text has); ties
of rank go by the shingle's hash, and a component is named after its smallest id; rows with equal ids
are one document; repeated rows each return a row; an empty table gives an empty result; other columns
are ignored, or passed on by ``clean``, which also leaves one of fully repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, durable, table
from .components import roots

ROWS = 2
TABLES = 12
PERCENT = 80
SHINGLE = 5
#: Shingles of a node that its rows carry to tell where a pair is made first.
FIRST = 128
#: Rows of one shingle that meet all others in one task: beyond, all are sent to each block of so many. And the part of all
#: rows, one in so many and LEAST_OFTEN at least, above which a shingle's count is broadcast.
SALTED, OFTEN, LEAST_OFTEN = 8192, 4096, 512

_random = np.random.RandomState(20)
_TIMES = _random.randint(1, 1 << 62, size=2 * TABLES * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.randint(0, 1 << 62, size=2 * TABLES * ROWS, dtype=np.int64).astype(np.uint64)


def shingled(chunk: kernels.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts of a chunk on end, and where each text's begin."""
    start, end, before = chunk.words()
    texts = len(chunk.offsets) - 1
    words = kernels.Hasher(kernels.LOWER[chunk.data]).of(start, end)
    n = np.diff(before)
    owner = np.repeat(np.arange(texts), n)
    whole = np.zeros(len(words), dtype=bool)
    whole[: len(words) - k + 1] = owner[: len(words) - k + 1] == owner[k - 1 :] if len(words) >= k else False
    at = np.flatnonzero(whole)
    hashes = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        hashes = kernels.mix(hashes * np.uint64(0x9FB21C651E98DF25) + words[at + j])
    owner = owner[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            short[has] = kernels.mix(short[has] * np.uint64(0x9FB21C651E98DF25) + words[before[few[has]] + j])
        hashes = np.concatenate([hashes, kernels.mix(short ^ np.uint64(0xABCDEF) + n[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def _node(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16 bytes for each set: two sums of its hashes, each mixed with another salt. Sets of unlike hashes
    have unlike sums but for a chance of 2 ** -128 a pair; hashes of unlike shingles are alike at 2 ** -64."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(kernels.mix(hashes ^ np.uint64(salt << 20)), out=sums[1:])
        out.append(sums[begin[1:]] - sums[begin[:-1]])
    return np.stack(out, axis=1).astype("<u8")


def _column(nodes: np.ndarray, some: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() if s else None for x, s in zip(nodes, some)], pa.binary())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null for an empty set), and left and right, the two key collections."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in kernels.chunks(b["text"]):
                hashes, begin = shingled(chunk, k)
                some = np.diff(begin) > 0
                keys = np.zeros((len(some), 2 * TABLES), dtype=np.uint64)
                if some.any():
                    for t in range(2 * TABLES):
                        key = np.full(int(some.sum()), t + 1, dtype=np.uint64)
                        for r in range(ROWS):
                            i = t * ROWS + r
                            least = np.minimum.reduceat((hashes ^ _MASKS[i]) * _TIMES[i], begin[:-1][some])
                            key = kernels.mix(key * np.uint64(31) + least)
                        keys[some, t] = key
                keys = keys.view(np.int64)
                lists = [pa.array([row.tolist() if s else None for row, s in zip(part, some)], pa.list_(pa.int64())) for part in (keys[:, :TABLES], keys[:, TABLES:])]
                part = b.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(np.diff(begin)), _column(_node(hashes, begin), some), *lists], names=["doc_id", "text_key", "n_shingles", "node", "left", "right"])

    return _texts(docs).mapInArrow(each, _kinds(docs, "n_shingles long, node binary, left array<long>, right array<long>"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _kinds(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, {rest}"


def sets(docs: DataFrame, k: int) -> DataFrame:
    """node and ``members``, the sorted shingle hashes as bytes, of every text of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in kernels.chunks(b["text"]):
                hashes, begin = shingled(chunk, k)
                some = np.diff(begin) > 0
                members = [hashes[x:y].astype("<u8").tobytes() for x, y in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([_column(_node(hashes, begin), some), pa.array(members, pa.binary())], names=["node", "members"])

    return docs.select("text").mapInArrow(each, "node binary, members binary")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets' intersection is at least ``percent`` of their union."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"])):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(members.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    with_b = with_a.join(members.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(each, "a binary, b binary")


def in_tables(nodes: DataFrame) -> DataFrame:
    """key, node, n: a row for each table of the index in which a node may meet another."""
    keys = nodes.select("node", F.explode(F.concat("left", "right")).alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1").select("key")
    met = keys.join(bounded(shared), "key", "left_semi").groupBy("node").agg(F.collect_set("key").alias("shared"))
    both = nodes.join(met, "node").select("node", "n", F.array_intersect("left", "shared").alias("left"), F.array_intersect("right", "shared").alias("right"))
    both = durable(both.filter((F.size("left") > 0) & (F.size("right") > 0)))
    return both.select("node", "n", "right", F.explode("left").alias("one")).select("node", "n", F.explode(F.transform("right", lambda r: F.xxhash64("one", r))).alias("key"))


def shingle_rows(members: DataFrame) -> DataFrame:
    """node, shingle of every set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(np.frombuffer(b["members"].buffers()[1], np.int32)[b["members"].offset :][: b.num_rows + 1]) // 8
            for first in range(0, b.num_rows, 64):
                part = b.slice(first, 64)
                flat = np.frombuffer(b"".join(part["members"].to_pylist()), "<i8")
                owner = pa.array(np.repeat(np.arange(part.num_rows), sizes[first : first + 64]))
                yield pa.RecordBatch.from_arrays([part["node"].take(owner), pa.array(flat)], names=["node", "shingle"])

    return members.select("node", "members").mapInArrow(each, "node binary, shingle long")


def across(rest: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes of different roots that may be similar enough: a superset of those that are.

    ``rest``: node, n, root. A node keeps the first n - least + 1 of its shingles, rare ones first,
    where least is the smallest intersection with any partner; a shingle that only it has takes
    a rank but no row. ``reach`` is the size of the largest partner that a match at this rank allows.

    Shingles of more than 1 / OFTEN of all rows are at most OFTEN, so their counts are broadcast and
    their rows are not dealt by shingle; in the join of nodes, the rows of a shingle are dealt in
    blocks of SALTED, each of which meets all the others.
    """
    rows = shingle_rows(members)
    often = max(LEAST_OFTEN, (rest.agg(F.sum("n")).first()[0] or 0) // OFTEN)
    counts = durable(rows.groupBy("shingle").count().filter("count > 1"))
    hot = F.broadcast(counts.filter(F.col("count") > often))
    met = rows.join(hot.select("shingle"), "shingle", "left_anti").join(counts.filter(F.col("count") <= often), "shingle")
    met = met.select("shingle", "node", "count").union(rows.join(hot, "shingle").select("shingle", "node", "count")).join(rest, "node")
    by_node = Window.partitionBy("node")
    nth = F.row_number().over(by_node.orderBy("count", "shingle"))
    rank = F.col("n") - F.count(F.lit(1)).over(by_node) + nth
    reach = F.floor((F.col("n") - F.col("rank") + 1) * (100 + percent) / percent + 1e-6) - F.col("n")
    kept = durable(met.withColumns({"rank": rank, "nth": nth}).withColumn("reach", reach).filter(F.col("reach") * 100 >= F.col("n") * percent).select("node", "n", "root", "shingle", "nth", "reach"))
    mixed = kept.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).filter("low != high")
    # a pair is made by the first shingle that it shares; a node knows its first FIRST shingles, and a pair that shares
    # none of these is made by every one that it shares later
    kept = kept.join(mixed.select("shingle", "least", "rows"), "shingle").filter("reach >= least")
    kept = kept.withColumn("nth", F.row_number().over(by_node.orderBy("nth")))
    firsts = F.collect_list(F.when(F.col("nth") <= FIRST, F.col("shingle"))).over(by_node.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = kept.withColumn("firsts", firsts)
    blocks = F.ceil(F.col("rows") / SALTED).cast("int")
    kept = durable(kept.withColumn("blocks", blocks).drop("nth", "rows", "least"))
    one, two = (kept.select("shingle", "blocks", *[F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "root", "reach", "firsts")]) for i in (1, 2))
    one = one.withColumn("salt", F.pmod(F.xxhash64("node_1"), F.col("blocks")).cast("int")).drop("blocks")
    two = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    fits = (F.col("root_1") < F.col("root_2")) & (F.col("n_1") <= F.col("reach_2")) & (F.col("n_2") <= F.col("reach_1"))
    first = F.get(F.array_intersect("firsts_1", "firsts_2"), F.lit(0))
    fits &= F.coalesce(first, F.col("shingle")) == F.col("shingle")
    return one.join(two, ["shingle", "salt"]).filter(fits).select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, links of every row of ``docs``."""
    signs = durable(signatures(docs, k))
    nodes = signs.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("who"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), F.count(F.lit(1)).alias("rows")
    )
    nodes = durable(nodes)
    tables = in_tables(nodes)
    hubs = tables.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "hub")
    near_size = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pairs = tables.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & near_size(F.col("n"), F.col("hub.n")))
    pairs = durable(pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())

    def members_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "who.*"), "node").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        here = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
        return durable(sets(docs.select("doc_id", "text").join(bounded(durable(wanted)), here, "left_semi"), k).dropDuplicates(["node"]))

    links = durable(verified(pairs, members_of(pairs), percent))
    stars = roots(links)
    left = tables.join(bounded(stars.withColumnsRenamed({"a": "node", "b": "root"})), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    open_keys = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    rest = durable(left.join(bounded(durable(open_keys)), "key", "left_semi").select("node", "n", "root").distinct())
    more = across(rest, members_of(rest.select(F.col("node").alias("a"), F.col("node").alias("b"))), percent)
    more = durable(more.join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        found = durable(verified(more, members_of(more), percent))
        if found.limit(1).count():
            links = durable(links.union(found))
            stars = roots(links)

    # a node's component is named after the smallest id of any of its nodes
    placed = nodes.select("node", "who.doc_id").join(bounded(stars.withColumnsRenamed({"a": "node", "b": "root"})), "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    names = placed.join(bounded(linked), "node", "left_semi").select("node", "root", "doc_id")
    names = names.join(names.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("node", "component")
    alone = nodes.filter("rows > 1").select("node", F.col("who.doc_id").alias("least"))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    out = signs.select("doc_id", "text_key", "n_shingles", "node")
    for part in (alone, names, degree):
        out = out.join(bounded(durable(part)), "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "least", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of one document for each component."""
    found = durable(classes(docs))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"])
    left = docs.join(bounded(durable(gone)), same, "left_anti")
    if found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left
