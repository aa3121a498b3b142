"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: ASCII 0x20 and 0x09 to 0x0D, which is what bytes.split() cuts at.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, as one small file is, dealt over all of them; larger ones are left as they are. No result depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without (tests): on a cluster each machine would write to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{os.getpid()}"
    return folder


#: Deletes what a query has shuffled as soon as it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder. What was shuffled for it is not read again, and is deleted at once: the files of all rounds would lie on disk until the end."""
    spark = df.sparkSession
    sc, before = spark.sparkContext, spark.conf.get(CLEANED)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, which alone is cleaned
    finally:
        spark.conf.set(CLEANED, before)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The bytes of all texts, measured: plan statistics multiply the sizes of joined tables. It only sizes partitions; no result depends on it."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n)


def ascii_lower(col) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(text: str = "text") -> Column:
    """Tells rows apart by id and text, so null and repeated ids do no harm; equal rows share it."""
    return F.xxhash64("doc_id", F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
