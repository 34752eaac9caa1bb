"""Operator 8, quality rules: fixed rules on the counts of a text, then robust multivariate outliers.

Every text gives a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate of centre and scatter is found by concentration steps: rows are put
into narrow bins of Mahalanobis distance, sums are made for each bin, and the bins nearest the
centre that hold the share CORE of the rows give the next estimate. So a step is one aggregation
whose rows are few, over all rows; no group is gathered in a task, and the bins make it exact and
repeatable. Texts are short or long, and a short one strays further by chance: in the last distance, and only
there, each part's scatter is widened by what so many words leave to chance. A group of fewer than LEAST rows is judged with the other small groups of its
language, and if these are too few as well, with those of all languages; where even they are too
few the fixed rules decide alone.

Edge cases: a null text counts as empty; a null language or source is a group like others; a text
without words has a vector of zeros (the fixed rules reject it); a very long text is counted whole, in
memory that follows its length; ties of distance are kept or left together, as a bin is; repeated rows
each get a verdict, the same one; an empty table gives an empty result; other columns are ignored, or passed on by
``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import durable, table

#: The vector, and for each part a standard deviation that is added to the scatter. Capitals and word
#: length vary in any text, and theirs only keeps the matrix invertible. The central texts of a group
#: mostly have no symbols and no repeated lines at all, so there the floor is what a text may have:
#: at CUTOFF, alone, 18 symbols in 1,000 words or 45 % of the lines.
PARTS = {"symbols": 0.02, "capitals": 0.005, "word_length": 0.005, "line_repeats": 0.1}
#: What one word's chance adds to the variance of each part: a part of a text of n words may stray by this over n. By the
#: delta method, for a share under a square root a quarter (a word has five letters), for word length its squared variation.
CHANCE = {"symbols": 0.25, "capitals": 0.05, "word_length": 0.36, "line_repeats": 0.0}
CORE = 0.6
STEPS = 4
LEAST = 40
#: Squared distance beyond which a text is rejected: for four normal parts the quantile of chi-square with 4 in 10**9 beyond it.
CUTOFF = 45.0
BINS_PER_OCTAVE = 8
GROUPS_BROADCAST = 20_000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(chunk: kernels.Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """The counts of each text of a chunk, and its vector."""
    data, offsets = chunk.data, chunk.offsets
    texts = len(offsets) - 1
    start, end, before = chunk.words()
    n_words = np.diff(before)
    word_chars = chunk.per_text(((data & 0xC0) != 0x80) & ~kernels.SPACE[data])
    n_symbols = chunk.per_text(_SYMBOL[data])
    capitals = chunk.per_text(_CAPITAL[data])
    hasher = kernels.Hasher(data)
    salt = kernels.mix(np.arange(1, texts + 1, dtype=np.uint64))

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = np.where((line_end > line_start) & (data[line_end - 1] == 10), line_end - 1, line_end)
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    _, first = np.unique(kernels.mix(hasher.of(line_start, line_end) ^ salt[owner]), return_index=True)
    n_lines = np.bincount(owner, minlength=texts)
    n_dup_lines = n_lines - np.bincount(owner[first], minlength=texts)

    words = hasher.of(start, end)
    covered = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        owner = np.repeat(np.arange(texts), n_words)
        whole = owner[2:] == owner[:-2]
        key = kernels.mix(kernels.mix(words[:-2] ^ salt[owner[:-2]]) + kernels.mix(words[1:-1] * np.uint64(3)) * np.uint64(5) + words[2:] * np.uint64(7))
        at = np.flatnonzero(whole)
        key = key[at]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        for hit in (at[order[1:][same]], at[order[:-1][same]]):
            for j in range(3):
                covered[hit + j] = True
    sums = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(covered, out=sums[1:])
    n_repeat = sums[before[1:]] - sums[before[:-1]]

    some, chars, lines = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    vector = np.stack([np.sqrt(n_symbols / some), np.sqrt(capitals / chars), np.log(np.maximum(word_chars / some, 1)), np.sqrt(n_dup_lines / lines)], axis=1)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat], np.round(vector, 3)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, source, the counts, the vector and base_failed of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, vectors = [], []
            for chunk in kernels.chunks(b["text"]):
                c, v = measured(chunk)
                counts.append(np.stack(c, axis=1))
                vectors.append(v)
            if counts:
                c, v = np.concatenate(counts), np.concatenate(vectors)
                arrays = [b["doc_id"], b["text_key"], b["lang"], b["source"], *(pa.array(c[:, i], pa.int64()) for i in range(len(COUNTS))), *(pa.array(v[:, i]) for i in range(len(PARTS)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "lang", "source", *COUNTS, *PARTS])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, text_key long, lang string, source string, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{p} double" for p in PARTS])
    out = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "lang", "source", "text").mapInArrow(each, kinds)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(PARTS)) for j in range(i, len(PARTS))]


def consistency(share: float, p: int) -> float:
    """By how much the scatter of the central ``share`` of a normal sample must be raised; p even."""

    def cdf(x: float, k: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = (low, m) if cdf(m := (low + high) / 2, p) > share else (m, high)
    return share / cdf(low, p + 2)


def solved(sums: DataFrame) -> DataFrame:
    """group, centre and inverse scatter from each group's sums; the matrix is inverted by sweeping its diagonal."""
    scale, p = consistency(CORE, len(PARTS)), range(len(PARTS))
    out = sums.withColumns({f"c_{i}": F.col(f"s_{i}") / F.col("n") for i in p})
    floors = [f * f for f in PARTS.values()]
    out = out.withColumns({f"a_{i}_{j}": (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"c_{i}") * F.col(f"c_{j}")) * scale + (floors[i] if i == j else 0.0) for i, j in _pairs()})
    at = lambda i, j: F.col(f"a_{min(i, j)}_{max(i, j)}")
    for k in p:
        swept = {}
        for i, j in _pairs():
            if i == j == k:
                swept[f"a_{i}_{j}"] = -1 / at(k, k)
            elif k in (i, j):
                swept[f"a_{i}_{j}"] = at(i, j) / at(k, k)
            else:
                swept[f"a_{i}_{j}"] = at(i, j) - at(i, k) * at(k, j) / at(k, k)
        out = out.withColumns(swept)
    return out.select("group", F.array(*[F.col(f"c_{i}") for i in p]).alias("centre"), F.array(*[-at(i, j) for i, j in _pairs()]).alias("inverse"))


def distance(chance: bool = False) -> Column:
    """Squared Mahalanobis distance of a row that is joined with its group's estimate; with ``chance``, each part's way from
    the centre is measured against the scatter and what a text of ``n_words`` may stray by chance."""
    away = [F.col(p) - F.element_at("centre", i + 1) for i, p in enumerate(PARTS)]
    if chance:
        at = {i: k + 1 for k, (i, j) in enumerate(_pairs()) if i == j}
        n = F.greatest(F.col("n_words"), F.lit(1))
        away = [a / F.sqrt(1 + F.element_at("inverse", at[i]) * CHANCE[p] / n) if CHANCE[p] else a for i, (a, p) in enumerate(zip(away, PARTS))]
    terms = [away[i] * away[j] * F.element_at("inverse", k + 1) * (1 if i == j else 2) for k, (i, j) in enumerate(_pairs())]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def grouped(stats: DataFrame) -> DataFrame:
    """``stats`` with ``group``: its language and source, or where these are few its language, or all that is left."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    stats = stats.withColumns({"lang_key": name("lang"), "source_key": name("source")})
    sizes = stats.groupBy("lang_key", "source_key").count()
    enough = F.col("count") >= LEAST
    rest = F.sum(F.when(~enough, F.col("count"))).over(Window.partitionBy("lang_key"))
    group = F.when(enough, F.to_json(F.struct("lang_key", "source_key"))).when(rest >= LEAST, F.to_json(F.struct("lang_key"))).otherwise("{}")
    return stats.join(sizes.select("lang_key", "source_key", group.alias("group")), ["lang_key", "source_key"]).drop("lang_key", "source_key")


def estimates(stats: DataFrame) -> DataFrame:
    """group, centre, inverse of every group of ``stats`` (with ``group``)."""
    rows = stats.select("group", *PARTS)
    small = rows.select("group").distinct().count() <= GROUPS_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    quarters = rows.groupBy("group").agg(*[F.percentile(p, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias(p) for p in PARTS])
    spread = {p: F.greatest((F.get(F.col(p), F.lit(2)) - F.get(F.col(p), F.lit(0))) / 1.349, F.lit(floor)) for p, floor in PARTS.items()}
    names = list(PARTS)
    inverse = F.array(*[1 / (spread[names[i]] * spread[names[i]]) if i == j else F.lit(0.0) for i, j in _pairs()])
    found = quarters.select("group", F.array(*[F.get(F.col(p), F.lit(1)) for p in PARTS]).alias("centre"), inverse.alias("inverse"))
    sums = {f"s_{i}": F.col(p) for i, p in enumerate(names)} | {f"q_{i}_{j}": F.col(names[i]) * F.col(names[j]) for i, j in _pairs()}
    for _ in range(STEPS):
        ring = F.floor(F.log2(distance() + 2.0**-6) * BINS_PER_OCTAVE)
        rings = rows.join(hint(found), "group").groupBy("group", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
        by_ring = Window.partitionBy("group").orderBy("ring")
        inner = F.coalesce(F.sum("n").over(by_ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        every = F.sum("n").over(Window.partitionBy("group"))
        core = rings.withColumn("core", (inner < every * CORE) & (every >= LEAST)).filter("core").groupBy("group").agg(*[F.sum(F.round(c, 6)).alias(c) if c != "n" else F.sum(c).alias(c) for c in ("n", *sums)])
        found = solved(core)
    return hint(durable(found))


def judged(docs: DataFrame) -> DataFrame:
    """``statistics`` with outlier distance and ``kept``."""
    stats = grouped(durable(statistics(docs)))
    scored = stats.join(estimates(stats), "group", "left").withColumn("distance", distance(chance=True))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return scored.withColumn("kept", kept)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    gone = judged(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), F.col("lang").alias("_gone_lang"), F.col("source").alias("_gone_source")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"]) & docs["lang"].eqNullSafe(gone["_gone_lang"]) & docs["source"].eqNullSafe(gone["_gone_source"])
    return docs.join(gone, same, "left_anti")
