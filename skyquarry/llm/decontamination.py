r"""Operator 6, benchmark decontamination by winnowing. DataFrame functions only.

Both sides are cut into words, and every run of GRAM words is hashed. A document keeps the smallest
hash of every WINDOW consecutive ones, so any span of WINDOW + GRAM - 1 = SPAN words that it shares
with a benchmark item shares a kept hash. Kept hashes are joined with those of the benchmark, and
each hit is extended to all windows of SPAN words around it, which are compared as words. An item
of fewer than SPAN words is one window of its own length; for each such length present (nine at
most), documents keep every hash of that length.

The benchmark's hashes are broadcast only up to BROADCAST_HASHES of them, counted first. Beyond
that, hashes are joined by shuffle to find the documents in question, and all windows of those.

Edge cases: a null or wordless text has no words and no hits; a wordless item has no windows and
occurs nowhere; equal items occur together; a very long text is one array of words, hashed whole; of
equal hashes in a window each place is extended; repeated rows are judged alike; an empty table on
either side gives no hits; other columns are ignored, or passed on by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
BROADCAST_HASHES = 500_000
#: ASCII characters that no word has. Listed one by one: a class of single characters is a bit set, one of ranges is a chain of tests.
_OTHER = [c for c in range(128) if not chr(c).isalnum()]
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in [*_OTHER, *range(65, 91)]) + "]++"
#: The same words, for counting without lower-casing first.
ANY_CASE_WORD = "[^" + "".join(f"\\x{c:02X}" for c in _OTHER) + "]++"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))


def winnowed(hashes: Column, w: int) -> Column:
    """The smallest of every w consecutive hashes."""
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1))), F.lit(1), F.greatest(F.size(hashes) - (w - 1), F.lit(0)))
    return F.array_distinct(hashes if w == 1 else F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, F.lit(w)))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window (words joined by a blank), n (its words), words, items (ids as strings of the equal items it is in)."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    distinct = texts.groupBy("words").agg(F.collect_set("item").alias("items"))
    n = F.least(F.size("words"), F.lit(SPAN))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    return distinct.select("items", n.alias("n"), "words", starts.alias("at")).select("items", "n", F.slice("words", F.col("at"), F.col("n")).alias("words")).withColumn("window", F.array_join("words", " "))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_hit, items (sorted ids as strings) of every contaminated document of ``docs``."""
    windows = benchmark_windows(benchmark)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most SPAN of them
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    found = None
    for n in lengths:
        k, w = (GRAM, WINDOW) if n == SPAN else (n, 1)
        mine = windows.filter(F.col("n") == n)
        hashed = texts.withColumn("grams", grams(F.col("words"), k))
        kept = mine.select(F.explode(winnowed(grams(F.col("words"), k), w)).alias("hash")).distinct()
        # explode() would add a test of the array's size, and with it make the array twice
        each = hashed.select("*", F.explode_outer(winnowed(F.col("grams"), w)).alias("hash"))
        if kept.count() <= BROADCAST_HASHES:
            met = each.join(F.broadcast(kept), "hash", "left_semi")
            at = F.explode(F.filter(F.sequence(F.lit(1), F.size("grams")), lambda j: F.element_at("grams", j) == F.col("hash"))).alias("j")
            near = met.select("doc_id", "text_key", "words", at)
            last = F.size("words") - (n - 1)
            starts = F.sequence(F.greatest(F.col("j") - (n - k), F.lit(1)), F.least(F.col("j"), last))
            near = near.filter(last > 0).select("doc_id", "text_key", "words", F.explode(starts).alias("at"))
        else:
            met = each.select("doc_id", "text_key", "hash").join(kept, "hash", "left_semi").select("doc_id", "text_key").distinct()
            same = hashed["doc_id"].eqNullSafe(met["doc_id"]) & (hashed["text_key"] == met["text_key"])
            near = hashed.filter(F.size("words") >= n).join(met, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
            near = near.select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (n - 1))).alias("at"))
        near = near.select("doc_id", "text_key", "at", F.array_join(F.slice("words", F.col("at"), F.lit(n)), " ").alias("window"))
        one = near.join(mine.select("window", "items"), "window").select("doc_id", "text_key", F.struct("at", (F.col("at") + n).alias("end")).alias("span"), "items")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.limit(0).select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    met = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", start,
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["at"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
    )["n"]
    return met.select("doc_id", "text_key", covered.alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    met = hits(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_hit", "items")
    joined = base.join(met, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit."""
    met = hits(docs, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"))
    return docs.join(met, docs["doc_id"].eqNullSafe(met["_hit_id"]) & (F.xxhash64(docs["text"]) == met["_hit_key"]), "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
