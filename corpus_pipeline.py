"""Corpus pipeline: quality rules, quality classifier, near-duplicates, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import minhash, packing, quality_classifier, quality_rules
from weft.llm.common import stash
from weft.llm.queries import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the adaptive thresholds of their language and source."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote for. The model learns from labelled rows of the whole table (crc32(doc_id as text) mod 3 not 1), so that it still knows what earlier stages removed."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality_classifier.crc_of_id() % 3 != 1)
    return quality_classifier.keep_likely(docs, quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by a similarity of 0.8 or more on shingles of five words."""
    gone = stash(minhash.minhash_dedup(docs, shingle=5).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in as few sequences as the packing finds."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_dedup", near_duplicates), ("best_fit_packing", packed)]

#: Verdicts of the model and packing have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stash(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
