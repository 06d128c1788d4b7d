"""A corpus pipeline of five stages; each works on all that the one before it kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, and other columns
whatever they are called; all but the last return the columns of their input. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import op1_packing, op3_mixing, op4_toxicity, op5_neardup, op8_secrets
from lumenfold.llm.common import cut, free_name, table

#: Training, hashing and draws have no twin in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut go; the model never learns from held-out labels.

    Rows, nulls and texts as in op4_toxicity.score; columns may have any names; repeated rows share their score.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~op4_toxicity.held_out())
    name = free_name(docs, "toxicity_score")
    return op4_toxicity.score(docs, labels, name).where(F.col(name) < op4_toxicity.CUT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id; of repeated rows one.

    Null, empty and blank texts are no duplicates and all stay; rows with a null doc_id take part, and where a
    group has such rows one of these stays.
    """
    return op5_neardup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced; n_chars is counted anew where that changed the text.

    Null texts stay null; of overlapping secrets one mark stands for all; repeated rows are scanned once and all stay.
    """
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("others")  # whatever they are called
    paths, _ = op8_secrets.scan(docs.select("text", others))
    clean = paths.select("others", (F.size("findings") > 0).alias("hit"), op8_secrets.redact(F.col("text"), F.col("findings")).alias("text"))
    counted = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("others.n_chars"))
    own = {"text": F.col("text"), "n_chars": counted}
    return clean.select(*[own.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it, at most three times, some not at all.

    Null source is a source of its own; null and empty texts have no words and go; repeated rows share their copies
    evenly; reruns agree.
    """
    return op3_mixing.apply(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows, as the mix makes them, are packed once each.
    """
    return op1_packing.pack(docs, op1_packing.default_tokenizer(), cache=250_000)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
