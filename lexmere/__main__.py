"""Command line: python -m lexmere <command>. Every command is one batch Spark job."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.functions.fixed import DEFAULT_EXPANSIONS, DEMO_QUESTIONS
from lexmere.operators import chunking, dictionary, mining
from lexmere.operators.context import MODES, OLDER_MODES
from lexmere.operators.expansion import DICTIONARY_SCHEMA, dictionary_table
from lexmere.operators.index import LexicalIndex, build_index, load_index, save_index
from lexmere.operators.ranking import numbered
from lexmere.operators.rerank import RERANKERS
from lexmere.operators.search import RETRIEVERS, search
from lexmere.plans.ask import fill_answers, make_prompts, run_report
from lexmere.plans.evaluation import evaluate
from lexmere.plans.ingest import DEFAULT_TOPICS, ingest
from lexmere.session import build_session
from lexmere.sources import readers, writers

def _index(spark: SparkSession, args: argparse.Namespace) -> LexicalIndex:
    if args.saved:
        return load_index(spark, args.index)
    return build_index(chunking.indexable(readers.read_chunks(spark, args.index)))


def _dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        return spark.read.schema(DICTIONARY_SCHEMA).json(path)
    return dictionary_table(spark, DEFAULT_EXPANSIONS)


def _options(p: argparse.ArgumentParser, *names: str) -> None:
    known = {
        "index": dict(required=True, help="chunk JSON Lines, or a saved index with --saved"),
        "saved": dict(action="store_true"),
        "evalset": dict(required=True),
        "out": dict(required=True),
        "retriever": dict(choices=RETRIEVERS, default="bm25"),
        "rerank": dict(choices=sorted(RERANKERS), default="none"),
        "mode": dict(choices=MODES, default="cite_strict"),
        "top_k": dict(type=int, default=8),
        "pool_k": dict(type=int, default=30),
        "max_chars": dict(type=int, default=1400),
        "dictionary": dict(default=None, help="dictionary table (JSON Lines)"),
    }
    for name in names:
        p.add_argument(f"--{name}", **known[name])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmere")
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("ingest", help="PDF folders to chunks")
    p.add_argument("--base", required=True)
    p.add_argument("--topics", nargs="+", default=list(DEFAULT_TOPICS))
    _options(p, "out")

    p = commands.add_parser("save-index", help="write postings for repeated searches")
    _options(p, "index", "saved", "out")

    p = commands.add_parser("search", help="ranked chunks of one question")
    p.add_argument("--question", required=True)
    p.add_argument("--topic", default=None)
    _options(p, "index", "saved", "retriever", "top_k", "dictionary")

    p = commands.add_parser("answer", help="report of evidence, outline and prompt")
    p.add_argument("--question", default=None)
    p.add_argument("--topic", default=None)
    p.add_argument("--no_outline", action="store_true")
    _options(
        p, "index", "saved", "retriever", "rerank", "top_k", "pool_k", "max_chars", "dictionary"
    )
    p.add_argument("--mode", choices=MODES + OLDER_MODES, default="explore")

    p = commands.add_parser("eval", help="recall and citation metrics")
    p.add_argument("--k", type=int, default=8)
    p.add_argument("--unit", choices=("sentence", "line"), default="sentence")
    _options(p, "index", "saved", "evalset", "retriever", "dictionary")

    p = commands.add_parser("fill-prompts", help="add a prompt to every question")
    _options(
        p, "index", "saved", "evalset", "out", "retriever", "rerank", "mode", "top_k", "pool_k",
        "max_chars", "dictionary",
    )

    p = commands.add_parser("fill-answers", help="add an outline answer to every question")
    _options(p, "index", "saved", "evalset", "out", "retriever", "top_k", "dictionary")

    p = commands.add_parser("suggest", help="mine dictionary candidates")
    p.add_argument("--chunks", required=True)
    p.add_argument("--top_abbr", type=int, default=80)
    p.add_argument("--top_ngram", type=int, default=200)
    _options(p, "out")

    p = commands.add_parser("review", help="candidates as a decision table to fill in")
    p.add_argument("--suggest", required=True)
    p.add_argument("--topic", default=None)
    p.add_argument("--limit_abbr", type=int, default=60)
    p.add_argument("--limit_ngram", type=int, default=40)
    p.add_argument("--ngrams", action="store_true", help="list n-grams too")
    _options(p, "out")

    p = commands.add_parser("curate", help="merge decisions into the dictionary")
    p.add_argument("--decisions", required=True)
    _options(p, "dictionary", "out")

    p = commands.add_parser("preview", help="first chunks and skip ratio")
    p.add_argument("--chunks", required=True)
    return top


DECISION_SCHEMA = (
    "seq long, kind string, trigger string, target string, accept boolean, extra array<string>"
)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    command = args.command
    if command == "ingest":
        ingest(spark, args.base, args.out, args.topics).show()
    elif command == "save-index":
        save_index(_index(spark, args), args.out)
    elif command == "search":
        asked = readers.inline_questions(spark, [(args.question, args.topic)])
        search(
            _index(spark, args),
            asked,
            retriever=args.retriever,
            top_k_=args.top_k,
            dictionary=_dictionary(spark, args.dictionary),
        ).orderBy("rank").show(args.top_k, truncate=False)
    elif command == "answer":
        pairs = [(args.question, args.topic)] if args.question else DEMO_QUESTIONS
        report = run_report(
            _index(spark, args),
            readers.inline_questions(spark, pairs),
            mode=args.mode,
            max_chars=args.max_chars,
            outline=not args.no_outline,
            retriever=args.retriever,
            rerank=args.rerank,
            top_k=args.top_k,
            pool_k=args.pool_k,
            dictionary=_dictionary(spark, args.dictionary),
        )
        report.orderBy("qid").show(truncate=False, vertical=True)
    elif command == "eval":
        evaluate(
            _index(spark, args),
            readers.read_questions(spark, args.evalset),
            retriever=args.retriever,
            k=args.k,
            unit=args.unit,
            dictionary=_dictionary(spark, args.dictionary),
        ).show(vertical=True)
    elif command == "fill-prompts":
        rows = make_prompts(
            _index(spark, args),
            readers.read_questions(spark, args.evalset),
            mode=args.mode,
            max_chars=args.max_chars,
            retriever=args.retriever,
            rerank=args.rerank,
            top_k=args.top_k,
            pool_k=args.pool_k,
            dictionary=_dictionary(spark, args.dictionary),
        )
        writers.write_jsonl(rows, args.out, order_by=["qid"], leave=["qid"])
    elif command == "fill-answers":
        rows = fill_answers(
            _index(spark, args),
            readers.read_questions(spark, args.evalset),
            retriever=args.retriever,
            top_k=args.top_k,
            dictionary=_dictionary(spark, args.dictionary),
        )
        writers.write_jsonl(rows, args.out, order_by=["qid"], leave=["qid"])
    elif command == "suggest":
        records = readers.read_records(spark, args.chunks)
        found = mining.suggestions(
            records, top_abbr=args.top_abbr, top_ngram=args.top_ngram
        )
        writers.write_document(mining.suggestions_document(found, args.chunks), args.out)
    elif command == "review":
        shown = dictionary.review_list(
            readers.read_suggestions(spark, args.suggest),
            topic=args.topic,
            limit_abbr=args.limit_abbr,
            limit_ngram=args.limit_ngram if args.ngrams else 0,
        )
        numbers = numbered(shown, "_n", [F.col("kind"), F.col("topic"), F.col("rank")])
        blank = numbers.select(
            (F.col("_n") + 1).alias("seq"),
            *shown.columns,
            F.lit(False).alias("accept"),
            F.array().cast("array<string>").alias("extra"),
        )
        writers.write_jsonl(blank, args.out, order_by=["seq"])
    elif command == "curate":
        before = _dictionary(spark, args.dictionary)
        decisions = spark.read.schema(DECISION_SCHEMA).json(args.decisions)
        if dictionary.change_count(decisions).first()["changes"] == 0:
            print("no changes selected")
            return
        after = dictionary.merge(before, decisions)
        writers.write_jsonl(after, args.out, order_by=["key_pos", "val_pos"])
        print(
            writers.dictionary_diff(before, after, "dictionary")
        )
    elif command == "preview":
        chunks = readers.read_chunks(spark, args.chunks)
        chunking.preview(chunks).show(truncate=False)
        chunking.skip_ratio(chunks).show()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(build_session(), args)


if __name__ == "__main__":
    main()
