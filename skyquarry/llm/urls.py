"""Operator 5, URL filters: rules first, then logistic regression on hashed character n-grams.

The n-grams of host and path are hashed into a fixed number of buckets; the weights are fitted on
the driver from the small labelled table below, whose size is the bound. A rule fits its host and
all subdomains of it where the path starts with the rule's; the longest fitting rule decides, and
the model decides, and is asked, only where no rule fits.

The table is made of words that name a topic, each in the shapes that hosts have, so the model knows
the word in hosts that it has not seen. A word whose n-grams no word of the table has gives it no
evidence, and it then allows: the README has the figures for both.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
left to the model, which allows the empty string; a very long url is scored whole, in memory of about
100 bytes for each of its own; a score of exactly 0 allows; ids of any type are passed on; repeated
rows are judged alike; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import ascii_lower, table

#: (host, path, verdict), as the contract fixes them.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

#: The labelled URLs: words of either kind, in these hosts and paths. At most 2,000 rows.
BAD_WORDS = (
    "casino", "poker", "slots", "jackpot", "roulette", "bets", "betting", "gambling", "lottery", "bingo", "porn", "xxx", "adult", "escort", "webcam", "nude", "sexy", "hentai",
    "viagra", "cialis", "pills", "pharma", "steroid", "payday", "loans", "credit", "forex", "crypto", "spam", "phishing", "malware", "trojan", "keygen", "warez", "torrent", "crack",
    "adserver", "tracker", "clicks", "popunder", "affiliate", "doubleads", "banners", "replica",
)
GOOD_WORDS = (
    "library", "science", "weather", "history", "garden", "museum", "cooking", "school", "travel", "astronomy", "council", "recipes", "university", "hospital", "theatre", "railway", "football", "geology",
    "physics", "poetry", "orchestra", "newspaper", "village", "archive", "mountain", "forest", "bakery", "language", "grammar", "painting", "bicycle", "harbour", "chemistry", "software", "compiler", "database",
    "teacher", "children", "election", "parliament", "medicine", "research", "engineer", "cathedral",
)
NEUTRAL_WORDS = ("best", "my", "the", "online", "club", "world", "site", "net", "city", "home", "free", "top", "info", "shop", "zone", "hub")
HOSTS = ("{word}.com", "www.{word}.org", "{other}{word}.net", "{word}-{other}.com", "m.{other}-{word}.io", "blog.{word}{other}.example")
#: Names made of syllables, all good: what no word explains is no reason to block.
NAMES = 400
PATHS = ("/", "/en/{n}", "/{n}/index.html", "/a/{other}/{n}.html", "", "/de/{n}")

BUCKETS = 1 << 15
NGRAMS = (3, 4, 5)


def labelled() -> list[tuple[str, str, int, str]]:
    """(host, path, 1 for block, word) of the training table."""
    rows = [("", "", 0, "")]
    for bad, words in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for i, word in enumerate(words):
            for j, (host, path) in enumerate(zip(2 * HOSTS, PATHS + PATHS[::-1])):
                other = NEUTRAL_WORDS[(5 * i + 3 * j) % len(NEUTRAL_WORDS)]
                rows.append((host.format(word=word, other=other), path.format(other=other, n=37 * i + 11 * j), bad, word))
    # neutral words, and names without a meaning, say nothing
    rows += [(f"www.{a}{b}.com", "/en/1", 0, "") for a, b in zip(NEUTRAL_WORDS, (*NEUTRAL_WORDS[3:], *NEUTRAL_WORDS[:3]))]
    names = random.Random(NAMES)
    for i in range(NAMES):
        word = "".join(names.choice("bdfgklmnprstvw") + names.choice("aeiou") + names.choice(("", "", "n", "r", "l", "s")) for _ in range(names.randrange(2, 5)))
        rows.append((HOSTS[i % len(HOSTS)].format(word=word, other=names.choice(NEUTRAL_WORDS)), PATHS[i % len(PATHS)].format(other="x", n=i), 0, word))
    return rows


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """row and bucket of the distinct character n-grams of ``^host$`` and ``^path$`` of each row, in UTF-8."""
    out = []
    for kind, texts in enumerate((hosts, paths), 1):
        bytes_ = [b"^" + t.encode("utf-8", "replace") + b"$" for t in texts]
        ends = np.cumsum([len(b) for b in bytes_], dtype=np.int64)
        data = np.frombuffer(b"".join(bytes_), dtype=np.uint8)
        row = np.repeat(np.arange(len(texts)), [len(b) for b in bytes_])
        hasher = kernels.Hasher(data)
        for n in NGRAMS:
            at = np.flatnonzero(np.arange(len(data)) + n <= ends[row]) if len(data) else np.zeros(0, dtype=np.int64)
            bucket = (kernels.mix(hasher.of(at, at + n) + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)
            out.append(row[at] * BUCKETS + bucket)
    found = np.unique(np.concatenate(out))
    return found // BUCKETS, found % BUCKETS


def scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    row, bucket = features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return bias + np.bincount(row, weights=weights[bucket], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1))


def train(rows: list[tuple], rounds: int = 300, rate: float = 60.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept by plain gradient descent; the same rows give the same model."""
    row, bucket = features([r[0] for r in rows], [r[1] for r in rows])
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    x[row, bucket] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    y = np.array([r[2] for r in rows], dtype=np.float32)
    w, b = np.zeros(len(used), dtype=np.float32), np.float32(0)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= np.float32(rate) * (x.T @ error / len(y) + np.float32(decay) * w)
        b -= np.float32(rate / 10) * error.mean()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, float(b)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to the next ``/``, ``?`` or ``#``; path: from there to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*+)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*+)", 1)


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``, and the model's score where no rule fits."""
    weights, bias = train(labelled())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, np.nan)
            ask = np.flatnonzero(b["rule"].is_null().to_numpy(zero_copy_only=False))
            for first in range(0, len(ask), 1024):
                some = pa.array(ask[first : first + 1024])
                out[some.to_numpy()] = scores(b["host"].take(some).to_pylist(), b["path"].take(some).to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=np.isnan(out))], names=[*b.schema.names, "score"])

    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    ruled = parts.withColumns({"rule": rule, "verdict": verdict})
    scored = ruled.mapInArrow(score, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
