"""Chunking as a stream: new page files become chunk files.

Chunking is stateless per page, so it runs unchanged on a stream. Corpus statistics
cover all chunks and stay a batch job over the chunk table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmere.operators.chunking import chunk_pages

PAGE_SCHEMA = "path string, stem string, topic string, title string, page int, text_raw string"


def page_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).format(fmt).load(folder)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the chunks of every page seen so far, then stop; restartable."""
    return (
        chunk_pages(pages)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
