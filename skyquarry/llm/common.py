"""What the training-data operators share: reading, durable cuts of lineage, word patterns."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as the contracts of most operators have it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a table that may be one row group, and then all one task's.
SMALL_TABLE = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one so small that it may be a single row group is dealt out, as text costs far more to work on than
    to move. Larger ones are read as they are split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts say; lower() would also fold other alphabets."""
    return F.translate(text, _UPPER, _LOWER)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder for what must outlive executors: ``spark.checkpoint.dir``, and where that
    is unset a temporary one, but only in local mode, where no executor is elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyquarry-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no recomputation
    and later passes reread the small digest instead of the texts."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few fixed-width columns that a broadcast may have.
BROADCAST_ROWS = 250_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
