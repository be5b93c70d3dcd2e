"""Ranked results to weighted contexts, prompts and outline answers.

Results are (qid, rank, score, chunk_id) with at most k rows per question, so every
per-question list built here is bounded by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.fixed import (
    BLOCK_SEPARATOR,
    DRAFT_OUTLINE,
    DRAFT_TAIL,
    EVIDENCE_HEADING,
    OLDER_OUTLINE_HEAD,
    OLDER_OUTLINE_LINE,
    OLDER_OUTLINE_NOTE,
    PROMPTS,
    SUPPORT_HEADING,
)
from lexmere.functions.text import page_of, printed, python_list, strip
from lexmere.operators.index import with_chunks
from lexmere.session import written

MODES = ("explore", "cite_strict")
OLDER_MODES = ("strict", "english")  # over the flat context


def mode_name(mode: str | None, known: tuple[str, ...] = MODES) -> str:
    name = (mode or "explore").lower()
    if name not in known:
        raise ValueError(f"unknown mode {mode!r}; use one of {known}")
    return name


def support_cap(max_chars: int, tail_frac: float = 0.35) -> int:
    """Characters of a support block; float product cut to an int, never below 100."""
    return max(100, int(max_chars * tail_frac))


def with_payload(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join text and metadata back, after the cut: text of other chunks never moves.

    The ranked ids (questions x k rows) are written first, so the search runs once; the
    chunk table is then read once against them. In a saved index only the folders and row
    groups of the ranked ids are read.
    """
    ranked = written(results, "ranked")
    key = "doc_key" if "doc_key" in ranked.columns else "chunk_id"
    return with_chunks(chunks, ranked, key, ["text", "topic", "title", "page"])


def weights(results: DataFrame, mode: str = "ratio", tau: float = 1.0) -> DataFrame:
    """Add `w`: score / best score, or a softmax of the scores, per question."""
    group = Window.partitionBy("qid")
    best = F.max("score").over(group)
    if mode == "softmax":
        heat = tau if tau > 0 else 1.0
        lifted = F.exp((F.col("score") - best) / F.lit(heat))
        return results.withColumn("_e", lifted).withColumn(
            "w", F.col("_e") / F.sum("_e").over(group)
        ).drop("_e")
    return results.withColumn("w", F.col("score") / F.when(best > 0, best).otherwise(1.0))


def _page(c: str = "page") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?"))


def _one_line(text: str = "text") -> Column:
    return F.translate(strip(F.col(text)), "\n", " ")


def _ordered(df: DataFrame, item: str, separator: str, out: str) -> DataFrame:
    """(qid, out): the items of each question joined in rank order."""
    listed = df.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", item))).alias("_l"))
    return listed.select(
        "qid", F.array_join(F.transform("_l", lambda x: x[item]), separator).alias(out)
    )


def context_blocks(
    results: DataFrame,
    *,
    max_chars: int = 1400,
    evidence_k: int = 3,
    tail_frac: float = 0.35,
    weight_mode: str = "ratio",
    tau: float = 1.0,
) -> DataFrame:
    """(qid, rank, section, block): one header-plus-body block per result with payload."""
    best = max(0, int(evidence_k))
    cap = F.when(F.col("rank") <= best, max_chars).otherwise(support_cap(max_chars, tail_frac))
    header = F.format_string(
        "[#%d | w=%s | score=%s | %s | p%s | %s | topic=%s]",
        "rank",
        printed(F.col("w"), 2),
        printed(F.col("score"), 4),
        "chunk_id",
        _page(),
        F.coalesce("title", F.lit("")),
        python_list(F.coalesce("topic", F.array().cast("array<string>"))),
    )
    body = F.substring(_one_line(), F.lit(1), cap)
    return weights(results, weight_mode, tau).select(
        "qid",
        "rank",
        F.when(F.col("rank") <= best, "evidence").otherwise("support").alias("section"),
        F.concat(header, F.lit("\n"), body).alias("block"),
    )


def contexts(results: DataFrame, *, evidence_k: int = 3, **layout) -> DataFrame:
    """(qid, context): all blocks of a question with the section headings as blocks."""
    best = max(0, int(evidence_k))
    blocks = context_blocks(results, evidence_k=evidence_k, **layout)
    if best > 0:
        heading = (
            F.when(F.col("rank") == 1, EVIDENCE_HEADING + BLOCK_SEPARATOR)
            .when(F.col("rank") == best + 1, SUPPORT_HEADING + BLOCK_SEPARATOR)
            .otherwise("")
        )
        blocks = blocks.withColumn("block", F.concat(heading, F.col("block")))
    return _ordered(blocks, "block", BLOCK_SEPARATOR, "context")


def flat_contexts(results: DataFrame, *, max_chars: int = 1400) -> DataFrame:
    """(qid, context): the older layout, one list, score last in the header."""
    header = F.format_string(
        "[%s | p%s | %s | topic=%s | score=%s]",
        "chunk_id",
        _page(),
        F.coalesce("title", F.lit("")),
        python_list(F.coalesce("topic", F.array().cast("array<string>"))),
        printed(F.col("score"), 4),
    )
    body = F.substring(_one_line(), 1, max_chars)
    blocks = results.select("qid", "rank", F.concat(header, F.lit("\n"), body).alias("block"))
    return _ordered(blocks, "block", BLOCK_SEPARATOR, "context")


def _filled(template: str, **parts: Column) -> Column:
    """A template as one concat; {name} places become columns, in order of appearance."""
    pieces: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def prompt_text(question: str, context: str, mode: str | None = "explore") -> Column:
    """The chat prompt for a question and its context, as a Column.

    Modes: explore, cite_strict; strict and english are the older templates.
    """
    return _filled(
        PROMPTS[mode_name(mode, MODES + OLDER_MODES)],
        question=strip(F.col(question)),
        context=strip(F.coalesce(context, F.lit(""))),
    )


def prompts(questions: DataFrame, context: DataFrame, mode: str | None = "explore") -> DataFrame:
    """Questions plus `prompt`; a question without results gets an empty context."""
    joined = questions.join(context, "qid", "left")
    return joined.withColumn("prompt", prompt_text("question", "context", mode)).drop("context")


def outline_answers(results: DataFrame, limit: int = 8) -> DataFrame:
    """(qid, answer): one citing line per result, no full stops, page taken from the id."""
    line = F.format_string(
        "Relevant evidence line %d (%s, p%d)", "rank", "chunk_id", page_of(F.col("chunk_id"))
    )
    lines = results.filter(F.col("rank") <= limit).select("qid", "rank", line.alias("line"))
    return _ordered(lines, "line", "\n", "answer")


def older_outlines(questions: DataFrame, results: DataFrame, limit: int = 6) -> DataFrame:
    """Questions plus `answer`: the older outline, its page taken from the payload."""
    line = F.format_string(OLDER_OUTLINE_LINE, "rank", "chunk_id", _page())
    top = results.filter(F.col("rank") <= limit).select("qid", "rank", line.alias("line"))
    joined = questions.join(_ordered(top, "line", "\n", "_lines"), "qid", "left")
    answer = F.concat_ws("\n", F.lit(OLDER_OUTLINE_HEAD), F.lit(""), "_lines", F.lit(""), F.lit(OLDER_OUTLINE_NOTE))
    return joined.withColumn("answer", answer).drop("_lines")


def drafts(
    questions: DataFrame, results: DataFrame, *, bullets: int = 6, chars: int = 260,
    cited: bool = True,
) -> DataFrame:
    """Questions plus `draft`: an outline to fill in, with the best snippets as bullets."""
    bullet = F.format_string(
        "- %s (%s, p%s)", F.substring(_one_line(), 1, chars), "chunk_id", _page()
    )
    top = results.filter(F.col("rank") <= bullets).select("qid", "rank", bullet.alias("bullet"))
    listed = _ordered(top, "bullet", "\n", "_bullets")
    text = _filled(
        DRAFT_OUTLINE,
        question=F.col("question"),
        tail=F.lit(DRAFT_TAIL if cited else ""),
        bullets=F.coalesce("_bullets", F.lit("")),
    )
    # lines of blanks only become empty lines
    text = F.regexp_replace(text, r"(?m)^[ \t]+$", "")
    return questions.join(listed, "qid", "left").withColumn("draft", text).drop("_bullets")


def evidence_lists(results: DataFrame) -> DataFrame:
    """(qid, evidence): one line per result, as a run report shows it."""
    line = F.format_string(
        "- %s %s (p%s, title=%s)", printed(F.col("score"), 4), "chunk_id", _page(), F.coalesce("title", F.lit(""))
    )
    return _ordered(results.select("qid", "rank", line.alias("line")), "line", "\n", "evidence")
