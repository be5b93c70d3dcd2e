"""PDF folders or page tables to a chunk table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lexmere.operators.chunking import chunk_pages, counts
from lexmere.sources.readers import Extractor, extract_pages, list_pdfs, pdf_text
from lexmere.sources.writers import write_jsonl

DEFAULT_TOPICS = ("econometrics", "reinforcement_learning")


def ingest(
    spark: SparkSession,
    base: str,
    out: str,
    topics: Sequence[str] = DEFAULT_TOPICS,
    extract: Extractor = pdf_text,
) -> DataFrame:
    """Chunk every PDF under base/<topic> into JSON Lines at `out`; returns the numbers of
    files read, those without text included, and of chunks."""
    files = list_pdfs(spark, base, topics)
    chunks = chunk_pages(extract_pages(files, extract))
    write_jsonl(chunks, out)
    return counts(spark.read.schema(chunks.schema).json(out), files)
