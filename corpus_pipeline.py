"""The training-data pipeline: stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return the columns of `documents`, whatever they are called: columns other than doc_id and text travel in one struct, so none clashes with
what an operator adds. Null and empty texts fail the base rule of the first stage; null ids, repeated rows, ties and very long texts are treated as the operators' docstrings
say; an empty table gives an empty result. The last one returns doc_id, n_tokens, the token ids (little-endian unsigned
32-bit integers) and digests of the ids and of the bytes that they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import byte_bpe, decontaminate, near_copies, quality_gbt, secret_ledger
from quernstone.llm.common import shared_folder


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in one struct, the other columns."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(None).cast("int").alias("__none")).alias("__rest"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in ("doc_id", "text") else F.col(f"__rest.`{c}`").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the trees reject go."""
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(quality_gbt.judge(apart(docs), model).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; no document goes."""
    found, _ = secret_ledger.scan_incremental(apart(docs))
    clean = found.withColumn("text", secret_ledger.redact(found))
    chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("__rest.n_chars"))
    return restored(clean.withColumn("__rest", F.col("__rest").withField("n_chars", chars)), docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    import public_tokenizers

    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, round_trip=True)
    return byte_bpe.digests(ids, more=["ids"])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("byte_level_bpe", byte_level_bpe)]

#: Trees, components and merges are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; intermediate tables go to the shared folder of spark.checkpoint.dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table that no later stage reads; the last one stays, since the result is made from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
