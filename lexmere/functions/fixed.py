"""Values that results depend on. They are data, not logic."""

from __future__ import annotations

from functools import cache
from importlib import resources


@cache
def english_stop_words() -> tuple[str, ...]:
    """Default stop list of the index tokeniser, read from the packaged text file."""
    text = resources.files("lexmere.resources").joinpath("english_stop_words.txt").read_text("utf-8")
    return tuple(text.split())


# ---- fixed values: query expansion dictionary (key -> appended phrases) ----
DEFAULT_EXPANSIONS: dict[str, list[str]] = {
    "fixed effects": ["FE", "within estimator", "within transformation", "demeaning"],
    "first differencing": ["FD", "first-difference", "difference estimator"],
    "random effects": ["RE", "GLS", "quasi-demeaning"],
    "strict exogeneity": ["strictly exogenous", "FE.1", "FD.1", "leads test"],
    "hausman": ["hausman test", "endogeneity test", "specification test"],
    "instrument": ["IV", "2SLS", "GMM"],
    "endogeneity": ["IV", "2SLS", "control function", "hausman"],
    "gmm": ["two-step", "weighting matrix", "moment conditions", "optimal gmm"],
    "hac": ["Newey-West", "long-run variance", "kernel", "bandwidth"],
    "policy gradient": ["REINFORCE", "advantage", "baseline"],
    "ppo": ["clip", "KL", "policy ratio", "surrogate objective"],
    "kl": ["KL divergence", "relative entropy", "trust region"],
    "actor critic": ["advantage", "value function", "TD error"],
    "temporal difference": ["TD", "TD error", "bootstrapping"],
    "continuous time": ["SDE", "HJB", "Ito", "controlled diffusion"],
    "stochastic control": ["HJB", "Bellman", "dynamic programming"],
}

# ---- fixed values: contents-page keywords ----
CONTENTS_KEYWORDS = (
    "table of contents", "contents", "index", "acknowledgments", "acknowledgements",
    "preface", "bibliography", "references", "list of figures", "list of tables",
)

# ---- fixed values: mining stop words, generic words, abbreviation patterns ----
MINING_STOP_WORDS = tuple(
    """the a an and or to of in on for with by as at from that this these those
    is are was were be been being it its we our you your they their i me my
    not no yes can could may might should would will do does did done
    into over under between within without than then there here such also""".split()
)
GENERIC_WORDS = (
    "model", "models", "method", "methods", "result", "results", "data", "analysis",
)
LONG_THEN_ABBR = r"([A-Za-z][A-Za-z0-9\- ]{6,120}?)\s*\(\s*([A-Z][A-Z0-9\-]{1,9})\s*\)"
ABBR_THEN_LONG = r"\b([A-Z][A-Z0-9\-]{1,9})\s*\(\s*([A-Za-z][A-Za-z0-9\- ]{6,120}?)\s*\)"

# ---- fixed values: citation pattern ----
CITATION = r"\(([^,]+?)\s*,\s*p(\d+)\)"

# ---- fixed values: context layout ----
EVIDENCE_HEADING = "## Evidence (high priority)"
SUPPORT_HEADING = "## Support (lower priority)"
BLOCK_SEPARATOR = "\n\n---\n\n"

# ---- fixed values: prompt templates ----
PROMPTS: dict[str, str] = {
    "explore": """\
あなたは研究アシスタントです。以下の CONTEXT（抜粋）を優先して使い、日本語で分かりやすく答えてください。

【ルール（探索モード）】
- CONTEXTを最優先で使う。
- CONTEXT外の一般知識で補足してよいが、その場合は「（一般知識として補足）」と明示する。
- 断定しすぎず、前提・限界・代替解釈を短く添える。
- 重要な事実主張（定義・定理・数式・主張）には、可能な限り引用を付ける： (chunk_id, p#)
- CONTEXTが不足している場合は「不足」と言い、追加で検索すべきクエリ案を3つ提示する。

【出力フォーマット】
1) 要点（3〜6行）
2) 丁寧な説明（必要なら数式/直観/例）
3) 追加で確認したい点 / 追加retrievalクエリ案（3つ）

質問:
{question}

CONTEXT:
{context}
""",
    "cite_strict": """\
あなたは厳密な研究アシスタントです。以下の CONTEXT（抜粋）のみを根拠に、日本語で回答してください。

【ルール（引用強制モード）】
- CONTEXT以外の知識は一切使わない（推測・一般常識の補足も禁止）。
- 重要な主張は「1文=1主張」を意識し、各文の末尾に必ず引用を付ける： (chunk_id, p#)
- 1つの文で複数の主張をしない（分割する）。
- CONTEXTから直接言えない場合は、必ず「不足」と明示し、何が不足かを書き、追加で必要な検索クエリ案を3つ提示する。

【出力フォーマット】
A) 結論（各文に引用）
B) 根拠（箇条書き：各行=1主張 + 引用）
C) 不足している情報（あれば）
D) 追加retrievalクエリ案（3つ）

質問:
{question}

CONTEXT:
{context}
""",
    "strict": """\
あなたは厳密な研究アシスタントです。以下の CONTEXT（抜粋）のみを根拠に、日本語で回答してください。

【ルール（厳密モード）】
- CONTEXT以外の知識は一切使わない（推測・一般常識の補足も禁止）。
- すべての重要な主張（各箇条書き、または各文）に必ず引用を付ける： (chunk_id, p#)
- CONTEXTから直接言えない場合は、必ず「不足」と明示し、何が不足かを書き、追加で必要な検索クエリ案を提示する。
- 可能なら、前提条件（Assumption等）と、その含意（consistency/efficiency等）を分けて整理する。

【出力フォーマット】
A) 結論（引用付き）
B) 根拠（箇条書き：主張 + 引用）
C) 不足している情報（あれば）
D) 追加retrievalクエリ案（3つ）

質問:
{question}

CONTEXT:
{context}
""",
    "english": """\
# Task
Answer the QUESTION in Japanese using ONLY the CONTEXT.

# Rules (strict)
- Every factual claim must have at least one citation in the form: (chunk_id, p#).
- If the context is insufficient to answer part of the question, say what is missing and suggest what to retrieve next.
- Do not invent citations. Do not cite anything not in CONTEXT.

# QUESTION
{question}

# CONTEXT
{context}

# Output format
- Start with a short structured answer (3-6 bullets).
- Then add a brief explanation section.
- End with a "Citations used" list (chunk_id, page) (deduplicated).
""",
}

# ---- fixed values: fill-in outlines ({tail} is the citation reminder, empty in
# the older layout) ----
OLDER_OUTLINE_HEAD = "Answer (citation-per-sentence):"
OLDER_OUTLINE_LINE = "Evidence #%d: This chunk is relevant to the question. (%s, p%s)"
OLDER_OUTLINE_NOTE = "Note: Replace each 'Evidence' line with a true claim after running the prompt through an LLM."
DRAFT_OUTLINE = """\
Question:
{question}

Answer outline (evidence-first):
1) Definition / condition:
   - (Define it precisely; mention conditioning set and timing.){tail}

2) Main explanation:
   - (Key mechanisms / why it matters / intuition){tail}
   - (If relevant: consistency vs efficiency, assumptions, etc.){tail}

3) Practical diagnostics / fixes:
   - (What to test / what to add / how to interpret){tail}

Evidence bullets (auto-extracted):
{bullets}

Notes / follow-ups:
- (If evidence is insufficient, say what's missing and what to retrieve.)
"""
DRAFT_TAIL = " (chunk_id, p#)"

# ---- fixed values: notes of the suggestions document ----
SUGGESTION_NOTES = (
    "This file is for review. Add selected items into your EXPAND dictionary.",
    "Abbrev extraction looks for patterns like 'Long Form (ABBR)' and 'ABBR (Long Form)'.",
    "N-grams are simple frequency counts; expect noise—treat as a candidate list.",
)

# The questions a run without any asks.
DEMO_QUESTIONS = (
    ("Why does strict exogeneity matter for FE?", "econometrics"),
    ("Explain PPO objective with KL.", "reinforcement_learning"),
)
