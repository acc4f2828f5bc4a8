"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all rows that the stage before it kept, and all but the last
return the columns of ``documents``. The stages are the operators of
``panelforge.llm`` with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, line_dedup, packing, quality_classifier, simhash
from panelforge.llm.common import checkpoint


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; low-quality and toxic ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; those that have no text left go. n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates, as confirmed on 5-word shingles at 0.8. Rows that share an id are one document; rows without one stay."""
    return docs.join(simhash.confirmed_duplicates(docs), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Rows that share an id are one document; rows without one are judged by their text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.sha2("text", 256)))
    leaked = decontam.all_leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(leaked, "_key", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are checkpointed, as the next one reads them more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
