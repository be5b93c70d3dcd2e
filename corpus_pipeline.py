"""The corpus pipeline: quality rules, line dedup, near-dedup, packing.

Every stage takes the documents the one before has kept and is written as Parquet before
the next one reads it. Rows of equal doc_id are one document to the dedup stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm import linededup, neardedup, packing, quality
from lexmere.session import shared_folder

# Packing depends on a tokenizer, which SQL cannot express; a test compares the rows with
# a brute-force version.
ORACLE_SQL = None
NEAR_PERCENT = 80  # the 85 of op3_near_dedup belongs to its SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id holds too."""
    index = linededup.LineIndex(spark, f"{shared_folder(spark)}/line-index-{uuid.uuid4().hex}")
    index.insert_corpus(docs)
    kept = index.apply(docs)
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates, from NEAR_PERCENT up."""
    kept = neardedup.near_components(docs, neardedup.NearOptions(percent=NEAR_PERCENT)).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
