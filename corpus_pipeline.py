"""The corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last
adds where each row is stored. Rows may repeat after mixing, which lays a document into the mix as
often as its source's target asks.

Edge cases: a null or empty text, or one of fewer than 50 words, goes with the quality rules; a null id is
an id like others; fully repeated rows are one after near_duplicates; equal ids of unlike texts are one
document there, and the row of the smallest id of a group stays; null languages and sources are values
like others; very long texts are worked on whole by every stage; where stages tie, their modules say by
what they go; other columns are passed on, but for columns named shard and slot, which the last stage
sets; an empty table gives an empty one with the columns of the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skyquarry.llm import decontamination, mixing, neardup, quality, sharding
from skyquarry.llm.common import checkpoint_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.clean(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Robust estimates and MinHash are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages, from a table in the session's shared folder.

    A stage's table goes once the next one's is written.
    """
    base, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
