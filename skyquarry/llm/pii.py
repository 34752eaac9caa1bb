r"""Operator 2, PII: patterns propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. Every kind has a pattern, a score that its validator gives, and words
that raise or lower the score when they stand in the characters before the span; a span counts
when its score reaches the threshold. The four base kinds start at the threshold and lose nothing
by context, so a confirmed base span always stays; IBANs need mod-97; national ids in the form
ddd-dd-dddd, and secrets (runs of hex or base64 whose characters repeat little), need a supporting word.

Positions come from splitting the text at the matches: pieces and matches alternate, so the start
of a match is the sum of the lengths before it, made in blocks to stay near linear in a text of
very many matches. The patterns are written so that each scans a text once: a possessive run, with
a look-behind or ``\G`` so that no match is tried inside a run that has failed already.

Edge cases: a null text counts as empty; a text without spans has the digest of the empty string; a
very long text is scanned whole, once for each kind it may have; spans of several kinds that start
together are listed in the order of the kinds; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

THRESHOLD = 0.5
#: Characters before a span in which context words count.
NEAR = 40
BLOCK = 512


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    raised_by: str = ""
    lowered_by: str = ""
    needs: str = ""

    def near(self, words: str) -> str:
        """A pattern that finds one of ``words`` as a word, in lower case."""
        return f"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|server|host|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 0.7, "iban|account|konto|bank", "example|dummy"),
    Kind("national_id", r"(?<![0-9-])[0-9-]{11,}+", 0.3, "ssn|social|security|national id|tax id", "order|part|serial"),
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+", 0.3, "token|secret|key|apikey|api_key|password|passwd|bearer|credential", "checksum|commit|digest"),
)
BASE = 4
#: A secret's characters repeat so little that the squares of their counts, so many times, are within the square of its length.
SPREAD = 6


def luhn(digits: Column) -> Column:
    """Whether the string of digits passes the Luhn checksum."""
    d = F.split(F.reverse(digits), "")
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1: the first four characters go last, letters are 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "national_id":
        return F.rlike(match, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    if kind == "secret":
        chars = F.filter(F.split(match, ""), lambda c: c != "")
        squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c))), F.lit(0).cast("long"), lambda a, n: a + n * n)
        return F.rlike(match, F.lit("[0-9].*[0-9]")) & F.rlike(match, F.lit("[A-Za-z].*[A-Za-z]")) & (squares * SPREAD <= F.length(match).cast("long") * F.length(match))
    return F.lit(True)


def running(lengths: Column) -> Column:
    """Sums of an array of longs before each element, in two levels of blocks."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    empty = F.array().cast("array<bigint>")

    def before(xs: Column) -> Column:
        start = F.struct(zero.alias("sum"), empty.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))["out"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    starts = before(F.transform(blocks, total))
    return F.flatten(F.zip_with(blocks, starts, lambda xs, s: F.transform(before(xs), lambda x: x + s)))


def spans(text: Column, at: int) -> Column:
    """array<struct<start, kind, end, score>> of the confirmed spans of KINDS[at]."""
    kind = KINDS[at]
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    made = F.zip_with(pieces, matches, lambda p, m: F.struct(F.right(p, F.lit(NEAR)).alias("near"), m.alias("match"), F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))

    def scored(r: Column, start: Column) -> Column:
        near = ascii_lower(r["near"])
        score = F.lit(kind.score)
        if kind.raised_by:
            score = score + F.when(F.rlike(near, F.lit(kind.near(kind.raised_by))), 0.3).otherwise(0.0)
        if kind.lowered_by:
            score = score - F.when(F.rlike(near, F.lit(kind.near(kind.lowered_by))), 0.3).otherwise(0.0)
        begin = start + r["gap"]
        return F.struct(begin.alias("start"), F.lit(at).alias("kind"), (begin + r["n"]).alias("end"), F.when(confirmed(kind.name, r["match"]), score).otherwise(0.0).alias("score"))

    found = F.zip_with(made, running(F.transform(made, lambda r: r["gap"] + r["n"])), scored)
    found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    there = F.rlike(text, F.lit(kind.pattern))
    there = F.contains(text, F.lit(kind.needs)) & there if kind.needs else there
    return F.when(there, found).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end, score) by start, then kind; kinds index KINDS."""
    text = F.coalesce("text", F.lit(""))
    kinds = docs.select("doc_id", *[spans(text, i).alias(k.name) for i, k in enumerate(KINDS)])
    return kinds.select("doc_id", F.array_sort(F.concat(*[k.name for k in KINDS])).alias("spans"))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_kind(at: int):
    return lambda span: span["kind"] == at


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.array_size(F.filter("spans", is_kind(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *counts[:BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts[BASE:], F.array_size("spans").cast("long").alias("n_spans"))
