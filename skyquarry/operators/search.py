"""Text predicates and ranked searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import to_point

# What is said of a range that can't be used.
RANGES = ("Jump range must be a number of light years", "Jump range must be more than nothing")


def escaped(text: str) -> str:
    """A pattern that matches the text itself: the escape character first, then the wildcards."""
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return text


def escaped_column(text: Column) -> Column:
    for c in "\\%_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def like(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose name matches the pattern as it is given, by name."""
    return df.filter(F.ilike("name", F.lit(pattern))).orderBy("name")


def ranked(df: DataFrame, query: str, limit: int, *, near: tuple[float, float, float] | None = None, key: str = "address") -> DataFrame:
    """Names with the query in them: exact ones, then those that begin with it, then the nearest, then by name."""
    q = escaped(query)
    exact, prefix = F.ilike("name", F.lit(q)), F.ilike("name", F.lit(f"{q}%"))
    away = to_point(near) if near else F.lit(None).cast("double")
    found = df.filter(F.ilike("name", F.lit(f"%{q}%"))).withColumn("away", away)
    return found.orderBy(exact.desc(), prefix.desc(), F.col("away").asc_nulls_last(), "name", key).limit(limit)


def located(systems: DataFrame, names: list[str]) -> DataFrame:
    """asked, address, reason: the first of the names that can't be placed ends the list."""
    asked = systems.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, asked string")
    found = systems.groupBy("name").agg(F.min_by("address", F.struct(F.col("x").isNull(), F.col("address"))).alias("address"), F.max(F.col("x").isNotNull()).alias("positioned"))
    joined = F.broadcast(asked).join(found, F.upper("asked") == F.col("name"), "left")  # as long as the call's arguments
    reason = F.when(F.col("name").isNull(), F.concat(F.lit("No system named "), "asked")).when(~F.col("positioned"), F.concat("name", F.lit(" has no position on record")))
    rows = joined.select("place", "asked", "address", reason.alias("reason"))
    first_bad = rows.filter("reason IS NOT NULL").agg(F.min("place").alias("bad"))
    return rows.crossJoin(first_bad).filter("bad IS NULL OR place <= bad").drop("bad")


def blank_as_none(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def jump_range(text: Column) -> Column:
    """struct<range, message> of what was typed."""
    value = F.trim(text).try_cast("double")
    said = F.when(value.isNull(), RANGES[0]).when(~(value > 0) | F.isnan(value), RANGES[1])
    return F.struct(F.when(said.isNull(), value).alias("range"), said.alias("message"))


def trigrams(df: DataFrame, key: str = "address") -> DataFrame:
    """An index of names: gram, key, a row for each distinct run of three characters, in lower case."""
    name = F.lower("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3))))
    return df.filter(F.length("name") >= 3).select(F.explode(grams).alias("gram"), F.col(key).alias("key"))


def indexed(df: DataFrame, index: DataFrame, query: str, key: str = "address") -> DataFrame:
    """Rows whose name has the query in it, by way of the index where the query has a run of three to ask for."""
    wanted = sorted({query.lower()[i : i + 3] for i in range(len(query) - 2)})
    if wanted:
        met = index.filter(F.col("gram").isin(wanted)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        df = df.join(met.select(F.col("key").alias(key)), key, "left_semi")
    return df.filter(F.ilike("name", F.lit(f"%{escaped(query)}%")))
