"""Pages to overlapping chunks. Everything happens inside a page's row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.fixed import CONTENTS_KEYWORDS
from lexmere.functions.text import WS, clean, clean_lines, is_blank, paragraphs, strip, topic_of_path

MIN_PARAGRAPH = 80
TARGET_CHARS = 1800
OVERLAP_CHARS = 400

_TEXTS = "array<string>"
_LEADER = rf"(?U)\.{WS}*\.{WS}*\.{WS}*\."
_NUMBER_END = rf"(?U)\b\d{{1,4}}{WS}*$"


def packed(paras: Column, target: int = TARGET_CHARS) -> Column:
    """array<string>: consecutive paragraphs joined while they fit in `target`.

    A fold whose state is (finished chunks, open chunk, its length). A joined
    paragraph costs one separator; the first one after a cut does not. A paragraph
    longer than the target stays whole.
    """
    start = F.struct(
        F.array().cast(_TEXTS).alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("size"),
    )

    def closed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["done"]).otherwise(
            F.concat(s["done"], F.array(F.trim(s["open"])))
        )

    def step(s: Column, p: Column) -> Column:
        fits = s["size"] + F.length(p) + 1 <= target
        joined = F.when(s["open"].isNull(), p).otherwise(F.concat(s["open"], F.lit(" "), p))
        return F.struct(
            F.when(fits, s["done"]).otherwise(closed(s)).alias("done"),
            F.when(fits, joined).otherwise(p).alias("open"),
            F.when(fits, s["size"] + F.length(p) + 1).otherwise(F.length(p)).alias("size"),
        )

    return F.aggregate(paras, start, step, closed)


def with_overlap(chunks: str, tail: int = OVERLAP_CHARS) -> Column:
    """Prefix every chunk but the first with the end of the one before it."""
    return F.transform(
        chunks,
        lambda c, i: F.when(i == 0, c).otherwise(
            F.trim(
                F.concat(F.right(F.get(F.col(chunks), i - 1), F.lit(tail)), F.lit(" "), c)
            )
        ),
    )


def looks_like_contents(lines: str, page: str, whole_words: bool = False) -> Column:
    """True for contents, index and reference pages.

    `lines` is the array of cleaned lines. A keyword counts anywhere, inside longer
    words too unless `whole_words`; the two layout rules apply to the first 25 pages.
    """
    words = "|".join(CONTENTS_KEYWORDS)
    pattern = rf"(?U)\b({words})\b" if whole_words else words
    keyword = F.lower(F.array_join(lines, "\n")).rlike(pattern)
    top = F.slice(lines, 1, 80)
    leaders = F.size(F.filter(top, lambda x: x.rlike(_LEADER)))
    numbered = F.size(F.filter(top, lambda x: x.rlike(_NUMBER_END)))
    short = F.size(F.filter(top, lambda x: (F.length(x) <= 80) & x.rlike(_NUMBER_END)))
    layout = ((leaders >= 3) & (numbered >= 8)) | (short >= 12)
    return keyword | ((F.col(page) <= 25) & (F.size(lines) >= 8) & layout)


def flag_pages(pages: DataFrame) -> DataFrame:
    """Drop pages without text and add `skip` to the others."""
    held = pages.filter(F.col("text_raw").isNotNull() & ~is_blank(F.col("text_raw")))
    lined = held.select("*", clean_lines(F.col("text_raw")).alias("_lines"))
    return lined.select("*", looks_like_contents("_lines", "page").alias("skip")).drop("_lines")


def chunk_pages(
    pages: DataFrame,
    *,
    source_type: str = "paper",
    min_chars: int = MIN_PARAGRAPH,
    target_chars: int = TARGET_CHARS,
    overlap: bool = True,
) -> DataFrame:
    """(chunk_id, text, meta) from pages (path, stem, page, text_raw, title?, topic?)."""
    for name in ("title", "topic"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    title = strip(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("stem")))
    topic = F.coalesce(F.nullif(F.col("topic"), F.lit("")), topic_of_path(F.col("path")))
    described = flag_pages(pages).select(
        "stem",
        F.struct(
            F.lit(source_type).alias("source_type"),
            F.array(topic).alias("topic"),
            title.alias("title"),
            F.col("page").cast("int").alias("page"),
            F.col("path").alias("path"),
            F.col("skip").alias("skip"),
        ).alias("meta"),
        packed(paragraphs(F.col("text_raw"), min_chars), target_chars).alias("_c"),
    )
    texts = with_overlap("_c") if overlap else F.col("_c")
    return (
        described.select("stem", "meta", texts.alias("_c"))
        .select("stem", "meta", F.posexplode_outer("_c").alias("_j", "text"))
        .filter(F.col("text").isNotNull())
        .select(
            F.concat("stem", F.lit("::p"), "meta.page", F.lit("::c"), "_j").alias("chunk_id"),
            "text",
            "meta",
        )
    )


def indexable(chunks: DataFrame, keep_skipped: bool = False) -> DataFrame:
    """(chunk_id, text, topic, title, page): flat chunks, contents-like ones left out."""
    if not keep_skipped:
        chunks = chunks.filter(~F.coalesce("meta.skip", F.lit(False)))
    return chunks.select(
        "chunk_id",
        "text",
        F.coalesce("meta.topic", F.array().cast(_TEXTS)).alias("topic"),
        F.col("meta.title").alias("title"),
        F.col("meta.page").alias("page"),
    )


def preview(chunks: DataFrame, rows: int = 10, chars: int = 200) -> DataFrame:
    """The first chunks in id order with the start of their text on one line."""
    short = F.translate(F.substring("text", 1, chars), "\n", " ")
    return (
        chunks.orderBy("chunk_id")
        .limit(rows)
        .select("chunk_id", "meta.topic", "meta.page", short.alias("preview"))
    )


def skip_ratio(chunks: DataFrame) -> DataFrame:
    """One row: chunks, skipped chunks and their share (0 when there are none)."""
    skipped = F.count_if(F.coalesce("meta.skip", F.lit(False)))
    n = F.count("*")
    return chunks.agg(
        n.alias("chunks"),
        skipped.alias("skip"),
        F.when(n > 0, skipped / n).otherwise(F.lit(0.0)).alias("skip_ratio"),
    )


def counts(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: files and chunks.

    `files` (path, ...) lists what was read, so that files without any chunk count too;
    without it only files with chunks are known.
    """
    known = chunks.agg(F.count_distinct("meta.path").alias("n_files"), F.count("*").alias("n_chunks"))
    if files is None:
        return known
    read = files.agg(F.count_distinct("path").alias("n_files"))
    both = read.withColumn("_k", F.lit(1)).join(known.withColumn("_k", F.lit(1)).drop("n_files"), "_k")
    return both.drop("_k")
