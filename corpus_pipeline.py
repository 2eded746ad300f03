"""The corpus pipeline: five operators applied in turn to the documents table.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

1. toxicity: documents scored at or above its threshold go.
2. near_dedup: of each group of near duplicates the document with the smallest id stays.
3. decontaminate: documents that hold a test item's question and answer go.
4. secrets: every secret span is replaced by a mark; all documents stay.
5. mix: documents are sampled to the target marginals, with their weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import benchmark_hits
from millrace.llm.mixing import mix_sources
from millrace.llm.near_dedup import BROADCAST_IDS, checkpoint_folder, checkpointed, near_duplicates, small_batches
from millrace.llm.secret_scan import redacted, secret_spans
from millrace.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.  It learns from all labelled rows of the table of documents."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs.select(*COLUMNS), every, labels).where("predicted = 0").select(*COLUMNS)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles); rows without an id stay."""
    docs = docs.select(*COLUMNS)
    dropped = checkpointed(near_duplicates(docs.select("doc_id", "text")).where("not kept and doc_id is not null").select("doc_id").distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked test item.  Rows of equal id and text have equal hits; those with hits are found in small batches."""
    docs = docs.select(*COLUMNS)
    with small_batches(spark):
        found = benchmark_hits(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("size(hits) > 0")
        leaked = checkpointed(found.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")).distinct())
    few = leaked.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(leaked) if few else leaked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secret spans masked."""
    out = secret_spans(docs.select(*COLUMNS)).withColumn("text", redacted(F.col("text"), F.col("spans")))
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the target marginals, with their weights."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", keep_clean),
    ("near_dedup", keep_first_copies),
    ("decontaminate", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("mix", mix),
]
#: SQL can express neither the learned model nor the calibrated sample; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the store that the session's checkpoints are in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage returns is written to the shared folder and read again.

    A stage's folder goes once the next one is written; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, f"{folder}/{before}")
        before = name
    return docs
