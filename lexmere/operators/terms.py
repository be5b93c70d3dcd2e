"""Documents to terms, and corpus statistics over them.

Term counting needs no shuffle: a document is one row, so its terms are sorted and
run-length counted inside that row. Every stage is its own projection and the final
generator is an *outer* one. A plain `inline` would make the optimizer add a
"list is not empty" filter and push it, with the whole expression chain copied into
it, down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.fixed import english_stop_words
from lexmere.functions.text import NOT_WORD, long_words


@dataclass(frozen=True)
class TermOptions:
    """How text becomes terms, and which terms stay in the vocabulary.

    `stop_words` is "english", None or a tuple of words. `min_df` / `max_df` are
    document counts when int and shares of the corpus when float.
    """

    lowercase: bool = True
    stop_words: str | tuple[str, ...] | None = "english"
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int | float = 2
    max_df: int | float = 0.95

    def words_to_drop(self) -> tuple[str, ...]:
        if self.stop_words is None:
            return ()
        if self.stop_words == "english":
            return english_stop_words()
        if isinstance(self.stop_words, str):
            raise ValueError(f"unknown stop list: {self.stop_words}")
        return tuple(self.stop_words)

    def df_bounds(self, n_docs: int) -> tuple[float, float]:
        """Smallest and largest document frequency a vocabulary term may have."""
        low = self.min_df if isinstance(self.min_df, int) else self.min_df * n_docs
        high = self.max_df if isinstance(self.max_df, int) else self.max_df * n_docs
        return low, high


ALL_TERMS = TermOptions(min_df=1, max_df=1.0)


def with_ngrams(df: DataFrame, words: str, ngram_range: tuple[int, int], out: str) -> DataFrame:
    """Replace array column `words` by the n-grams of the range, as array `out`.

    Each n-gram array is the previous one walked in step with the words that follow.
    """
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError(f"bad ngram_range: {ngram_range}")
    rest = [c for c in df.columns if c != words]
    df = df.selectExpr(*rest, words, f"{words} AS _g1")
    for n in range(2, high + 1):
        held = f"greatest(size({words}) - {n - 1}, 0)"
        df = df.selectExpr(
            "*",
            f"""zip_with(slice(_g{n - 1}, 1, {held}), slice({words}, {n}, {held}),
                         (gram, word) -> concat_ws(' ', gram, word)) AS _g{n}""",
        )
    grams = ", ".join(f"_g{n}" for n in range(low, high + 1))
    return df.selectExpr(*rest, f"concat({grams}) AS {out}")


def term_arrays(docs: DataFrame, text: str, options: TermOptions, keep: list[str]) -> DataFrame:
    """(keep..., n_terms, counts array<struct<term, tf>>), one row per document, no shuffle."""
    source = f"coalesce({text}, '')"
    if options.lowercase:
        source = f"lower({source})"
    # words are the runs between separators: several times faster than matching each word
    found = docs.selectExpr(*keep, f"split({source}, r'{NOT_WORD}', -1) AS _w")
    kept = found.select(*keep, long_words("_w", options.words_to_drop()).alias("_w"))
    grams = with_ngrams(kept, "_w", options.ngram_range, "_t")
    return (
        grams.selectExpr(*keep, "sort_array(_t) AS _t")
        .selectExpr(
            *keep,
            "_t",
            """filter(transform(_t, (t, i) -> CASE WHEN i = 0 OR t <> get(_t, i - 1) THEN i END),
                      i -> i IS NOT NULL) AS _starts""",
        )
        .selectExpr(
            *keep,
            "size(_t) AS n_terms",
            """transform(_starts, (at, i) -> named_struct(
                 'term', get(_t, at),
                 'tf', coalesce(get(_starts, i + 1), size(_t)) - at)) AS counts""",
        )
    )


def array_rows(arrays: DataFrame) -> DataFrame:
    """(..., n_terms, term, tf): one row per distinct term of a document."""
    keep = [c for c in arrays.columns if c != "counts"]
    return arrays.select(*keep, F.inline_outer("counts")).filter(F.col("term").isNotNull())


def term_rows(docs: DataFrame, text: str, options: TermOptions, keep: list[str]) -> DataFrame:
    """(keep..., n_terms, term, tf): one row per distinct term of a document."""
    return array_rows(term_arrays(docs, text, options, keep))


def term_stats(rows: DataFrame, doc_id: str) -> DataFrame:
    """(term, df, cf, only_doc): one shuffle of map-side combined partials.

    `only_doc` is the document of a term that occurs in a single document, which
    is what lets document lengths be corrected without moving postings around. With a
    number as `doc_id` partials are hashed; a string would make Spark sort all rows first.
    """
    return rows.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("cf"),
        F.min(doc_id).alias("only_doc"),
    )


def bm25_idf(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5) + 1.0)


def smooth_idf(df: Column, n_docs: int | Column) -> Column:
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    return F.log((n + 1.0) / (df + 1.0)) + 1.0
