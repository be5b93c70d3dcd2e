"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm import backoff, linededup, mainhtml, neardedup, packing, phrases, quality, suffixes, syncmers, tokencounts, tokenfiles, topsearch, turnrepair
from lexmere.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = linededup.LineIndex(spark, scratch(spark, "line-index"))
    index.insert_corpus(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "host_failed",
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_components(table(spark, sf_dir, "documents"), neardedup.NearOptions(percent=85))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"), fill=True)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = suffixes.round_trip(table(spark, sf_dir, "documents"), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(suffixes.MARK), F.lit(" "))).alias("round_trip"),
    )


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch(spark, "token-files")
    manifest = tokenfiles.write_files(table(spark, sf_dir, "documents"), folder, path)
    return tokenfiles.digest(tokenfiles.read_files(spark, manifest))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = tokencounts.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repaired_summaries(table(spark, sf_dir, "conversations"))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topsearch.exact_top_k(table(spark, sf_dir, "embeddings"), 10, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_main_text": op1_main_text,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_syncmers": op5_syncmers,
    "op6_suffix_array": op6_suffix_array,
    "op7_vector_packing": op7_vector_packing,
    "op8_host_quality": op8_host_quality,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_target_alignment": op11_target_alignment,
    "op12_toivonen_phrases": op12_toivonen_phrases,
    "op13_exact_topk": op13_exact_topk,
}
