"""Where rows come from: tables, journals, two dump formats, a file-backed API, and what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.spatial import in_box, near_point

KEPT_EVENTS = ("Location", "FSDJump")


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, *, key: str, low: int, high: int, parts: int = 5) -> DataFrame:
    """A table of a database, read in parts by ranges of a key; the driver's jar must be on the class path."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def parsed(lines: DataFrame, schema: str = S.JOURNAL_EVENT) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines (column ``value``), and the lines that can't be read."""
    read = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    broken = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return read.filter(~broken).select("e.*").drop("_bad"), read.filter(broken & (F.trim("value") != "")).select("value")


def journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a journal file or a folder of them that place a commander, and unreadable lines."""
    events, bad = parsed(spark.read.text(path))
    return events.filter(F.col("event").isin(*KEPT_EVENTS)), bad


def dump_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV dump; broken rows and those without an address are skipped."""
    return spark.read.schema(S.DUMP_CSV).option("header", True).option("mode", "DROPMALFORMED").csv(path).filter(F.col("address").isNotNull())


def dump_json(spark: SparkSession, path: str, *, by_line: bool = False) -> DataFrame:
    """Systems of a JSON dump (one array); those without an id or coordinates are skipped.

    A file that is one value can't be split, so one task reads it whole. Where each entry of the array has a
    line of its own, as in large dumps, ``by_line`` reads lines, and files are split as any text.
    """
    if by_line:
        entry = F.regexp_replace(F.trim("value"), r"^\[\s*|\s*,$|\s*\]$", "")
        rows = spark.read.text(path).select(F.from_json(entry, S.DUMP_JSON).alias("e")).select("e.*")
    else:
        rows = spark.read.schema(S.DUMP_JSON).option("multiLine", True).json(path)
    whole = F.col("id64").isNotNull() & F.col("coords.x").isNotNull() & F.col("coords.y").isNotNull() & F.col("coords.z").isNotNull()
    return rows.filter(whole).select(F.col("id64").alias("address"), F.upper("name").alias("name"), "coords.x", "coords.y", "coords.z", F.col("date").alias("updated_at"))


def api(systems: DataFrame, *, name: str | None = None, sphere: tuple | None = None, cube: tuple | None = None) -> DataFrame:
    """What a remote catalogue is asked, over rows at hand: (point, radius), else (point, edge), else a name."""
    if sphere:
        return near_point(systems, *sphere)
    if cube:
        return in_box(systems, cube[0], cube[1] / 2)
    return systems.filter(F.col("name") == (name or "").upper())


def import_report(rows: DataFrame, error: Column, name: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """How many rows are good, how many there are for each error, and which these are, by name: a row for each."""
    checked = rows.withColumn("error", error)
    bad = checked.filter("error IS NOT NULL")
    return checked.agg(F.count_if(F.col("error").isNull()).alias("imported")), bad.groupBy("error").agg(F.count(F.lit(1)).alias("n")), bad.select("error", F.col(name).alias("name")).orderBy("error", "name")


def stream(spark: SparkSession, path: str, schema: str, *, pattern: str = "*", files: int = 100) -> DataFrame:
    """Files of a folder as they come, so many to a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)
