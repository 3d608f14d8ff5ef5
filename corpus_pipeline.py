"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

Every stage's result is written and read again, so a lost executor costs one stage at most. All but the last return the
columns of `documents`. Rows without a doc_id pass the stages that know documents by id; exact repeats of a row become
one row in near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm import decontaminate, line_dedup, minhash, packing, quality
from digestry.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILAR = 80  # per cent of common 5-word shingles


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, COLUMNS).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has go; a document that keeps no word of its text goes as a whole."""
    cut = line_dedup.dedup_lines(docs)
    changed = F.col("removed_lines") > 0
    return (cut.where(~(changed & ~F.col("text").rlike(r"[^\s]")))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest id."""
    kept = minhash.near_duplicates(docs, SIMILAR).where("kept").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack(docs, added=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

#: The classifier, the alignment and the packing plan are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
