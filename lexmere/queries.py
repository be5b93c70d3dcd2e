"""Registered queries: each operator run over the whole driver tables.

Stand-ins: a `documents` row is a page or a chunk, its `source` or `lang` a topic, a
`benchmark` row a question. Text the tables lack (blank-line paragraphs, contents
pages, abbreviations, citations) is derived from every document by an expression.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmere.functions.fixed import DEFAULT_EXPANSIONS
from lexmere.functions.text import paragraphs, printed, topic_list, units
from lexmere.operators import chunking, context, dictionary, evaluate, mining, rerank
from lexmere.operators.bounded import bounded_search
from lexmere.operators.expansion import dictionary_table, expand_questions
from lexmere.operators.index import LexicalIndex, build_index, load_index, save_index
from lexmere.operators.ranking import numbered
from lexmere.operators.search import search
from lexmere.operators.segments import GrowingIndex
from lexmere.operators.terms import TermOptions, bm25_idf, smooth_idf, term_rows
from lexmere.plans.ask import fill_answers, make_prompts, run_report
from lexmere.session import shared_folder, spread, written
from lexmere.sources.readers import SUGGESTION_SCHEMA, parsed_chunks, parsed_records, read_questions

Query = Callable[[SparkSession, str], DataFrame]


# ---- inputs -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk."""
    page = (F.col("doc_id") % 30 + 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit("::p"), page, F.lit("::c0")).alias("chunk_id"),
        "text",
        F.array("source").alias("topic"),
        F.concat(F.lit("Notes in "), "lang").alias("title"),
        page.alias("page"),
    )


def questions(spark: SparkSession, sf_dir: str, by_topic: bool = False) -> DataFrame:
    topic = F.concat(F.lit("src"), F.col("item_id") % 20) if by_topic else F.lit(None)
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("question"),
        topic.cast("string").alias("topic"),
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages per document: its text with blank lines between lines, and an outline of it."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    page = (F.col("doc_id") % 40 + 1).cast("int")
    body = F.replace("text", F.lit("\n"), F.lit("\n \n"))
    entries = F.regexp_replace("text", r"([^\n]{1,40})[^\n]*", "$1 .... 12")
    outline = F.concat(F.when(F.col("lang") == "de", "Contents\n").otherwise(""), entries)
    title = F.when(F.col("lang") == "en", F.concat(F.lit(" Notes "), "doc_id")).otherwise("")
    return docs.select(
        F.concat(F.lit("corpus/papers/"), "source", F.lit("/doc"), "doc_id", F.lit(".pdf")).alias(
            "path"
        ),
        F.concat(F.lit("doc"), "doc_id").alias("stem"),
        title.alias("title"),
        F.inline_outer(
            F.array(
                F.struct(page.alias("page"), body.alias("text_raw")),
                F.struct((page + 1).alias("page"), outline.alias("text_raw")),
            )
        ),
    )


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("pos"), "text", F.array("lang").alias("topics")
    )


def abbreviated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose word pairs around a comma carry abbreviations, in both directions; a written table, as several steps read the texts."""
    # tried at the start of a word only, without stepping back: the matches are the same
    around = r"(?<![a-z])([a-z]++ [a-z]++), ([a-z]++ [a-z]++)"
    marked = F.regexp_replace(
        F.col("text"),
        F.lit(around),
        F.concat(F.lit("$1 ("), F.upper("lang"), F.lit("), "), F.upper("source"), F.lit(" ($2)")),
    )
    records = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("pos"), marked.alias("text"), F.array("lang").alias("topics")
    )
    return written(records, "abbreviated-records")


def corpus_dictionary(index: LexicalIndex) -> DataFrame:
    """The default dictionary plus 40 frequent words, each pointing at two rarer ones."""
    spark = index.stats.sparkSession
    words = index.vocabulary().filter(~F.col("term").contains(" "))
    top = words.orderBy(F.col("df").desc(), "term").limit(120)
    ranked = top.select(
        "term", F.row_number().over(Window.orderBy(F.col("df").desc(), "term")).alias("r")
    )
    keys = ranked.filter("r <= 40").select(F.col("r").alias("kr"), F.col("term").alias("key"))
    near = keys.join(ranked, F.col("r") == F.col("kr") + 40).select(
        "kr", "key", F.lit(0).alias("val_pos"), F.col("term").alias("value")
    )
    far = keys.join(ranked, F.col("r") == 80 + F.floor((F.col("kr") + 1) / 2)).select(
        "kr", "key", F.lit(1).alias("val_pos"), F.upper("term").alias("value")
    )
    mined = near.unionByName(far).select(
        (F.col("kr") + 15).cast("long").alias("key_pos"),
        "key",
        F.col("val_pos").cast("long").alias("val_pos"),
        "value",
    )
    both = dictionary_table(spark, DEFAULT_EXPANSIONS).unionByName(mined)
    return written(both, "dictionary")


def doc_index(spark: SparkSession, sf_dir: str, forward: bool = True) -> LexicalIndex:
    return build_index(doc_chunks(spark, sf_dir), forward=forward)


def once_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """For statistics and one batch of BM25 questions."""
    return doc_index(spark, sf_dir, forward=False)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _results(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """BM25 results with payload."""
    index = once_index(spark, sf_dir)
    found = search(index, questions(spark, sf_dir), top_k_=k)
    return written(context.with_payload(found, index.chunks), "results")


# ---- terms and statistics -----------------------------------------------------


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spread(doc_chunks(spark, sf_dir), "chunk_id")
    rows = term_rows(chunks, "text", TermOptions(), ["chunk_id"])
    return rows.select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = once_index(spark, sf_dir)
    return index.vocabulary().select(
        "term",
        "df",
        "cf",
        F.round(bm25_idf(F.col("df"), index.n_docs), 6).alias("bm25_idf"),
        F.round(smooth_idf(F.col("df"), index.n_docs), 6).alias("tfidf_idf"),
    )


def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    return index.chunk_lengths().withColumn("avgdl", F.lit(round(index.avgdl, 6)))


# ---- search -------------------------------------------------------------------


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search(once_index(spark, sf_dir), questions(spark, sf_dir)))


def bm25_topk_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search(once_index(spark, sf_dir), questions(spark, sf_dir, by_topic=True)))


def _saved(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index written once and opened again, as a service would use it."""
    path = f"{shared_folder(spark)}/saved-index-{uuid.uuid4().hex}"
    save_index(build_index(doc_chunks(spark, sf_dir), counted=False), path)
    return load_index(spark, path)


def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search(_saved(spark, sf_dir), questions(spark, sf_dir)))


def tfidf_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search(_saved(spark, sf_dir), questions(spark, sf_dir), retriever="tfidf"))


def bm25_topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded search of the saved index, every question with and without a topic."""
    parts = [
        questions(spark, sf_dir, by_topic).select(F.concat(F.lit(kind), "qid").alias("qid"), "question", "topic")
        for kind, by_topic in (("all-", False), ("topic-", True))
    ]
    return _ranked(bounded_search(_saved(spark, sf_dir), parts[0].unionByName(parts[1])))


def bm25_after_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four batches, every seventh of the first two deleted before the others,
    one compaction on the way."""
    growing = GrowingIndex.create(spark, f"{shared_folder(spark)}/growing-index-{uuid.uuid4().hex}")
    number = F.regexp_extract("chunk_id", r"^doc(\d+)::", 1).cast("long")
    docs = doc_chunks(spark, sf_dir)
    for part in range(4):
        growing.append(docs.filter(number % 4 == part))
        if part == 1:
            growing.delete(docs.filter(number % 7 == 3).select("chunk_id"))
        if part == 2:
            growing.compact()
    return _ranked(search(growing.open(), questions(spark, sf_dir)))


def bm25_equal_question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions share an id, a fifth has none; each gets its own results."""
    item = F.col("item_id")
    shared = F.when(item % 5 != 4, F.concat(F.lit("q"), F.floor(item / 3)))
    path = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    asked = table(spark, sf_dir, "benchmark").select(shared.alias("id"), F.col("text").alias("question"), item)
    asked.write.json(path)
    asked = read_questions(spark, path, extra="item_id long")
    found = search(once_index(spark, sf_dir), asked)
    both = found.join(asked.select("qid", "id", "item_id"), "qid")
    return both.select("item_id", "id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents each share a chunk id, as files of one name in two folders do."""
    shared = F.concat(F.lit("doc"), F.floor(F.col("doc_id") / 2), F.lit("::p1::c0"))
    page = (F.col("doc_id") % 30 + 1).cast("int")
    chunks = table(spark, sf_dir, "documents").select(
        shared.alias("chunk_id"),
        "text",
        F.array("source").alias("topic"),
        F.concat(F.lit("Notes in "), "lang").alias("title"),
        page.alias("page"),
    )
    index = build_index(chunks, forward=False)
    found = context.with_payload(search(index, questions(spark, sf_dir)), index.chunks)
    return found.select("qid", "rank", "chunk_id", "page", F.round("score", 6).alias("score"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(doc_index(spark, sf_dir), questions(spark, sf_dir), retriever="tfidf")
    return _ranked(found)


def tfidf_topk_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir, by_topic=True)
    return _ranked(search(doc_index(spark, sf_dir), asked, retriever="tfidf"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus_dictionary(once_index(spark, sf_dir))
    return expand_questions(questions(spark, sf_dir), words).select("qid", "expanded")


def query_expansion_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vocabulary bigram as a dictionary key."""
    pairs = once_index(spark, sf_dir).vocabulary().filter(F.col("term").contains(" ")).select("term")
    words = numbered(pairs, "key_pos", [F.col("term")]).select(
        "key_pos", F.col("term").alias("key"), F.lit(0).cast("long").alias("val_pos"), F.replace("term", F.lit(" "), F.lit("_")).alias("value")
    )
    return expand_questions(questions(spark, sf_dir), words).select("qid", "expanded")


def bm25_other_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other weights, a higher least document frequency, no stop list, single words only."""
    index = build_index(doc_chunks(spark, sf_dir), TermOptions(stop_words=None, ngram_range=(1, 1), min_df=3), forward=False)
    return _ranked(search(index, questions(spark, sf_dir), k1=0.9, b=0.4))


def bm25_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = once_index(spark, sf_dir)
    words = corpus_dictionary(index)
    return _ranked(search(index, questions(spark, sf_dir), dictionary=words))


def tfidf_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    words = corpus_dictionary(index)
    found = search(index, questions(spark, sf_dir), retriever="tfidf", dictionary=words)
    return _ranked(found)


# ---- pages and chunks ---------------------------------------------------------


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        doc_pages(spark, sf_dir)
        .select("stem", "page", F.posexplode_outer(paragraphs(F.col("text_raw"))).alias("pos", "paragraph"))
        .filter(F.col("paragraph").isNotNull())
    )


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.flag_pages(doc_pages(spark, sf_dir)).select("path", "page", "skip")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_pages(doc_pages(spark, sf_dir))
    return chunks.select(
        "chunk_id",
        "text",
        "meta.source_type",
        F.array_join("meta.topic", ",").alias("topic"),
        "meta.title",
        "meta.page",
        "meta.path",
        "meta.skip",
    )


def skip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = chunking.skip_ratio(chunking.chunk_pages(doc_pages(spark, sf_dir)))
    return ratio.withColumn("skip_ratio", F.round("skip_ratio", 6))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.counts(chunking.chunk_pages(doc_pages(spark, sf_dir)))


def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chunking.preview(chunking.chunk_pages(doc_pages(spark, sf_dir)))
    return shown.withColumn("topic", F.array_join("topic", ","))


def bm25_over_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = written(chunking.chunk_pages(doc_pages(spark, sf_dir)), "chunks")
    index = build_index(chunking.indexable(chunks), forward=False)
    return _ranked(search(index, questions(spark, sf_dir, by_topic=True)))


def topic_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics written as list, empty list, scalar or not at all, read back from JSON text."""
    docs = table(spark, sf_dir, "documents")
    listed = F.to_json(F.array("source", "lang"))
    raw = (
        F.when(F.col("lang") == "en", listed)
        .when(F.col("lang") == "fr", F.lit("[]"))
        .when(F.col("lang") == "de", F.col("source"))
    )
    return docs.select("doc_id", F.array_join(topic_list(raw), ",").alias("topics"))


def record_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of every shape, one per document, as the mining reader takes them."""
    docs = table(spark, sf_dir, "documents")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.expr("substring(_json, 6, length(_json) - 6)")
    shapes = (
        '''{"text":%s,"meta":{"topic":"%s","page":"12"}}''',
        '''{"content":%s,"meta":{"topic":["%s","x"],"skip":"no"}}''',
        '''{"text":7,"chunk_text":%s,"meta":{"topic":5,"y":"%s"}}''',
        '''{"text":%s,"meta":{"topic":{"k":"%s"},"page":3.5}}''',
        '''{"text":%s,"meta":["%s"]}''',
        '''{"text":%s,"meta":{"topic":[],"z":"%s"}}''',
        '''{"text":%s, broken "%s"''',
    )
    made = docs.withColumn("_json", text).withColumn("_text", quoted)
    line = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        line = F.when(F.col("doc_id") % len(shapes) == k, F.format_string(shape, "_text", "source")).otherwise(line)
    records = parsed_records(made.select(F.col("doc_id").alias("pos"), line.alias("value")))
    return records.select(F.col("pos").alias("doc_id"), "text", F.array_join("topics", ",").alias("topics"))


def chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lines whose meta holds values of any type, one per document."""
    docs = table(spark, sf_dir, "documents")
    quoted = F.expr("substring(_json, 6, length(_json) - 6)")
    shapes = (
        '''{"chunk_id":"c%d","text":%s,"meta":{"topic":["%s","x"],"page":12,"skip":false}}''',
        '''{"chunk_id":"c%d","text":%s,"meta":{"topic":"%s","page":"12","skip":"no"}}''',
        '''{"chunk_id":"c%d","text":%s,"meta":{"title":"%s","page":3.5,"skip":0}}''',
        '''{"chunk_id":"c%d","text":%s,"meta":{"topic":[],"title":7,"path":"%s","skip":[1]}}''',
        '''{"chunk_id":"c%d","text":%s,"y":"%s"}''',
        '''{"chunk_id":"c%d","text":%s,"meta":{"topic":null,"page":null,"skip":null,"z":"%s"}}''',
    )
    made = docs.withColumn("_json", F.to_json(F.struct(F.col("text").alias("t")))).withColumn("_text", quoted)
    line = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        line = F.when(F.col("doc_id") % len(shapes) == k, F.format_string(shape, "doc_id", "_text", "source")).otherwise(line)
    chunks = parsed_chunks(made.select(line.alias("value")))
    return chunks.select("chunk_id", "text", F.array_join("meta.topic", ",").alias("topic"), "meta.title", "meta.page", "meta.path", "meta.skip")


# ---- results to prompts -------------------------------------------------------


def result_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(once_index(spark, sf_dir), questions(spark, sf_dir))
    ratio = context.weights(found).withColumnRenamed("w", "w_ratio")
    both = context.weights(ratio, "softmax", 2.0).withColumnRenamed("w", "w_softmax")
    return both.select(
        "qid",
        "rank",
        "chunk_id",
        F.round("w_ratio", 6).alias("w_ratio"),
        F.round("w_softmax", 6).alias("w_softmax"),
    )


def header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a header prints them: many eighths and sixteenths lie between two."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        printed(F.col("n_chars") / 8, 2).alias("eighths"),
        printed(F.col("n_chars") / 16, 2).alias("sixteenths"),
        printed(-F.col("n_chars") / 32, 4).alias("fourths"),
        printed(F.col("n_chars") / 1000, 2).alias("thousandths"),
    )


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_blocks(_results(spark, sf_dir))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.contexts(_results(spark, sf_dir))


def flat_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.flat_contexts(_results(spark, sf_dir))


def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = make_prompts(once_index(spark, sf_dir), questions(spark, sf_dir, by_topic=True), dictionary=None)
    return made.select("qid", "topic", "prompt", F.to_json("prompt_meta").alias("prompt_meta"))


def explore_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    made = context.prompts(asked, context.contexts(_results(spark, sf_dir)), "explore")
    return made.select("qid", "prompt")


def older_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older strict template and the English one, over flat contexts."""
    results = _results(spark, sf_dir)
    strict = questions(spark, sf_dir).join(context.flat_contexts(results), "qid", "left")
    return strict.select(
        "qid",
        context.prompt_text("question", "context", "strict").alias("strict"),
        context.prompt_text("question", "context", "english").alias("english"),
    )


def outline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = once_index(spark, sf_dir)
    return fill_answers(index, questions(spark, sf_dir), dictionary=None).select("qid", "answer")


def older_outline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = context.older_outlines(questions(spark, sf_dir), _results(spark, sf_dir))
    return made.select("qid", "answer")


def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file has no text at all and still counts as read."""
    pages = doc_pages(spark, sf_dir)
    number = F.regexp_extract("stem", r"(\d+)$", 1).cast("long")
    pages = pages.withColumn("text_raw", F.when(number % 3 != 0, F.col("text_raw")).otherwise(""))
    return chunking.counts(chunking.chunk_pages(pages), pages)


def draft_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafted = context.drafts(questions(spark, sf_dir), _results(spark, sf_dir))
    return drafted.select("qid", "draft")


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_report(once_index(spark, sf_dir), questions(spark, sf_dir), dictionary=None)
    return made.select("qid", "evidence", "draft", "prompt")


def rerank_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search(once_index(spark, sf_dir), questions(spark, sf_dir), top_k_=30)
    return _ranked(rerank.identity(pool, questions(spark, sf_dir), 8))


def rerank_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    return _ranked(rerank.mmr()(_results(spark, sf_dir, 30), asked, 8))


# ---- evaluation ---------------------------------------------------------------


def _eval_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions with TF-IDF gold ids (none for short ones) and answers citing the BM25
    top ten, the question and one unknown chunk; with the BM25 top eight."""
    index = doc_index(spark, sf_dir)
    asked = questions(spark, sf_dir)
    gold = (
        search(index, asked, retriever="tfidf", top_k_=3)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list("chunk_id")).alias("_gold"))
    )
    found = written(search(index, asked, top_k_=10).select("qid", "rank", "chunk_id"), "top-ten")
    lines = context.outline_answers(found, limit=10).withColumnRenamed("answer", "_lines")
    rows = asked.join(gold, "qid", "left").join(lines, "qid", "left")
    rows = rows.select(
        "qid",
        "question",
        "topic",
        F.when(F.length("question") > 180, F.col("_gold")).alias("gold_chunk_ids"),
        F.concat_ws(
            "\n", "_lines", "question", F.lit("As noted (unknown::p1::c0, p1). See below.")
        ).alias("answer"),
    )
    return written(rows, "evaluation-set"), found.filter("rank <= 8")


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _eval_set(spark, sf_dir)
    got = evaluate.recall(rows, found)
    return got.withColumn("recall_at_k", F.round("recall_at_k", 6))


def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _eval_set(spark, sf_dir)
    rates = ("citation_sentence_rate", "uncited_sentence_rate", "bad_citation_rate")
    parts = [
        evaluate.faithfulness(rows, found, unit).select(
            F.lit(unit).alias("unit"),
            "units",
            "cited",
            "cites",
            "bad",
            *[F.round(r, 6).alias(r) for r in rates],
        )
        for unit in ("sentence", "line")
    ]
    return parts[0].unionByName(parts[1])


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _eval_set(spark, sf_dir)
    got = evaluate.metrics(rows, found)
    rates = [c for c in got.columns if not c.startswith("n_")]
    return got.select("n_total", "n_with_gold", "n_with_answer", *[F.round(r, 6).alias(r) for r in rates])


def answer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parts = [
        turns.select(
            "conv_id",
            "turn",
            F.lit(unit).alias("unit"),
            F.posexplode_outer(units(F.col("text"), unit)).alias("pos", "part"),
        ).filter(F.col("part").isNotNull())
        for unit in ("sentence", "line")
    ]
    return parts[0].unionByName(parts[1])


# ---- mining and curation ------------------------------------------------------


def ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.top_ngrams(mining.ngram_counts(doc_records(spark, sf_dir)))


def review_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams numbered through in review order."""
    counts = mining.ngram_counts(doc_records(spark, sf_dir))
    order = [F.col("topic"), F.col("count").desc(), F.col("n").desc(), F.col("ngram").desc()]
    return numbered(counts, "seq", order).select("seq", "topic", F.col("n").cast("int").alias("n"), "ngram", "count")


def abbrev_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = mining.abbreviation_matches(abbreviated_records(spark, sf_dir), snippets=False)
    best = mining.top_abbreviations(mining.abbreviation_counts(matches))
    return best.select("topic", "rank", "abbr", "long", "count")


def abbrev_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = mining.abbreviation_matches(abbreviated_records(spark, sf_dir))
    return mining.abbreviation_examples(written(matches, "abbreviations"))


def suggestion_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_topic = mining.suggestions(abbreviated_records(spark, sf_dir))
    shown = dictionary.review_list(per_topic)
    return shown.select(
        "topic", "kind", "rank", "trigger", "target", "count", F.size("examples").alias("n_examples")
    )


def suggestions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested suggestions document, read back into one row per entry."""
    per_topic = mining.suggestions(abbreviated_records(spark, sf_dir))
    document = written(mining.suggestions_document(per_topic, "documents"), "suggestions-document")
    held = document.select(F.from_json("value", SUGGESTION_SCHEMA).alias("d")).select("d.*")

    def entries(column: str, name: str, target: Column, n: Column, examples: Column) -> DataFrame:
        topics = held.select("source_chunks", F.explode(column).alias("topic", "items"))
        return topics.select("source_chunks", "topic", F.posexplode("items").alias("position", "x")).select(
            "source_chunks",
            "topic",
            F.lit(column).alias("part"),
            "position",
            F.col(f"x.{name}").alias("name"),
            target.alias("target"),
            n.alias("n"),
            F.col("x.count").alias("count"),
            examples.alias("examples"),
        )

    nothing = F.lit(None).cast("string")
    pairs = entries("abbrev_pairs_by_topic", "abbr", F.col("x.long"), F.lit(None).cast("int"), F.array_join("x.examples", "|"))
    grams = entries("ngrams_by_topic", "ngram", nothing, F.col("x.n"), nothing)
    return pairs.unionByName(grams)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the mined candidates: all pairs seen twice, n-grams with a vowel first."""
    best = mining.top_abbreviations(
        mining.abbreviation_counts(
            mining.abbreviation_matches(abbreviated_records(spark, sf_dir), snippets=False)
        ),
        60,
    )
    grams = mining.top_ngrams(mining.ngram_counts(doc_records(spark, sf_dir)), 40)
    none = F.array().cast("array<string>")
    # review order: topics by name, pairs before n-grams, then rank
    place = F.ascii("topic") * 256 + F.ascii(F.substring("topic", 2, 1))
    pairs = best.select(
        (place * 1000 + F.col("rank")).cast("long").alias("seq"),
        F.lit("abbr").alias("kind"),
        F.col("abbr").alias("trigger"),
        F.col("long").alias("target"),
        (F.col("count") >= 2).alias("accept"),
        F.when(F.col("count") >= 3, dictionary.split_list(F.concat("topic", F.lit(" , , "), F.upper("topic"))))
        .otherwise(none)
        .alias("extra"),
    )
    taken = grams.select(
        (F.lit(100_000_000) + place * 1000 + F.col("rank")).cast("long").alias("seq"),
        F.lit("ngram").alias("kind"),
        F.col("ngram").alias("trigger"),
        F.lit(None).cast("string").alias("target"),
        F.col("ngram").rlike("^[aeiou]").alias("accept"),
        F.split("ngram", " ").alias("extra"),
    )
    return pairs.unionByName(taken)


def dictionary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = dictionary_table(spark, DEFAULT_EXPANSIONS)
    new = dictionary.merge(old, _decisions(spark, sf_dir))
    return new.select("key_pos", "key", "val_pos", "value")


def dictionary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.change_count(_decisions(spark, sf_dir))


def dictionary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = dictionary_table(spark, DEFAULT_EXPANSIONS)
    lines = dictionary.diff(old, dictionary.merge(old, _decisions(spark, sf_dir)))
    return lines.select("pos", "mark", "key", F.array_join("values", "|").alias("values"))


def dictionary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = dictionary_table(spark, DEFAULT_EXPANSIONS)
    view = dictionary.rendered(dictionary.merge(old, _decisions(spark, sf_dir)))
    return view.select("last", "key", F.array_join("values", "|").alias("values"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        term_frequency,
        term_statistics,
        chunk_lengths,
        bm25_topk,
        bm25_topk_by_topic,
        bm25_saved_index,
        tfidf_saved_index,
        bm25_topk_bounded,
        bm25_after_appends,
        bm25_repeated_ids,
        bm25_equal_question_ids,
        tfidf_topk,
        tfidf_topk_by_topic,
        query_expansion,
        query_expansion_large,
        bm25_other_settings,
        bm25_expanded,
        tfidf_expanded,
        page_paragraphs,
        page_flags,
        page_chunks,
        skip_ratio,
        chunk_counts,
        chunk_preview,
        bm25_over_chunks,
        topic_normalise,
        record_variants,
        chunk_variants,
        header_numbers,
        result_weights,
        context_blocks,
        contexts,
        flat_contexts,
        prompt_records,
        explore_prompts,
        older_prompts,
        outline_answers,
        older_outline_answers,
        files_read,
        draft_outlines,
        run_reports,
        rerank_identity,
        rerank_mmr,
        recall_at_k,
        citation_metrics,
        evaluation_metrics,
        answer_units,
        ngram_top,
        review_numbering,
        abbrev_top,
        abbrev_examples,
        suggestion_review,
        suggestions_json,
        dictionary_merge,
        dictionary_changes,
        dictionary_view,
        dictionary_diff,
    )
}
