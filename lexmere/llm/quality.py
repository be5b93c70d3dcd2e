"""Host-level quality rules: judge every document, then its host, then the document again.

Each document gets rule figures from its whole text, computed inside its row by array
expressions. Failures of each rule are counted per host, a host's failure rate is shrunk
towards all hosts by a beta prior fitted to the host rates (method of moments), and the
verdict on a host is joined back to its documents.

Defined cases: a null text counts as empty; a null host has no host verdict, so its
documents are judged by themselves; repeated rows are judged row by row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.session import BROADCAST_ROWS, SALTS, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
RULES = ("short", "repeated", "symbols", "copied_lines")


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules, and the shrunk failure rate beyond which a host is rejected."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10
    line_percent: int = 30
    host_rate: float = 0.5
    max_strength: float = 1e6


def word_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    n_lines counts the lines that hold a word. No shuffle. For the repeated words, the
    3-word windows are sorted inside the row; a window equal to a neighbour is repeated,
    and its words are counted once where windows overlap.
    """
    staged = docs.selectExpr(*keep, f"coalesce({text}, '') AS _t").selectExpr(
        *keep,
        "_t",
        rf"array_remove(split(_t, r'{SPACE}+', -1), '') AS _w",
        rf"filter(split(_t, '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]') AS _l",
    )
    staged = staged.selectExpr(
        *keep,
        "cast(size(_w) AS long) AS n_words",
        "cast(char_length(array_join(_w, '')) AS long) AS word_chars",
        f"cast(char_length(_t) - char_length(regexp_replace(_t, '{SYMBOL}', '')) AS long) AS n_symbols",
        "cast(size(_l) AS long) AS n_lines",
        "cast(size(_l) - size(array_distinct(_l)) AS long) AS n_dup_lines",
        """sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (a, i) -> named_struct(
             'h', xxhash64(a, get(_w, i + 1), get(_w, i + 2)),
             'a', a, 'b', get(_w, i + 1), 'c', get(_w, i + 2), 'at', i))) AS _v""",
    )
    figures = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    same = "get(_v, {j}).h = v.h AND get(_v, {j}).a = v.a AND get(_v, {j}).b = v.b AND get(_v, {j}).c = v.c"
    staged = staged.selectExpr(
        *keep,
        *figures,
        f"""sort_array(array_compact(transform(_v, (v, i) -> CASE
              WHEN i > 0 AND {same.format(j="i - 1")} THEN v.at
              WHEN i + 1 < size(_v) AND {same.format(j="i + 1")} THEN v.at END))) AS _r""",
    )
    return staged.selectExpr(
        *keep,
        *figures,
        """aggregate(transform(_r, (at, i) -> least(3, coalesce(get(_r, i + 1), at + 3) - at)),
             0L, (n, x) -> n + x) AS n_repeat_words""",
    )


def _failed(rules: HostRules) -> dict[str, str]:
    return {
        "short": f"n_words < {rules.min_words}",
        "repeated": f"100 * n_repeat_words > {rules.repeat_percent} * n_words",
        "symbols": f"100 * n_symbols > {rules.symbol_percent} * n_words",
        "copied_lines": f"100 * n_dup_lines > {rules.line_percent} * n_lines",
    }


def host_rates(figures: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """(host, n, <rule>_rate...): shrunk failure rates of every host; null hosts left out.

    Counts are combined before the shuffle, so a host with a third of all rows costs one
    row per task. The prior needs one row of moments over the host table.
    """
    stored = "tests" in figures.columns
    counted = figures.filter("host IS NOT NULL").groupBy("host")
    hosts = counted.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col(f"tests.{rule}") if stored else F.expr(test)).alias(rule) for rule, test in _failed(rules).items()),
    )
    moments = hosts.agg(
        *(F.avg(F.expr(f"{r} / n")).alias(f"{r}_mean") for r in RULES),
        *(F.var_pop(F.expr(f"{r} / n")).alias(f"{r}_var") for r in RULES),
    ).first()
    rates = []
    for rule in RULES:
        mean, var = moments[f"{rule}_mean"] or 0.0, moments[f"{rule}_var"] or 0.0
        strength = rules.max_strength
        if var > 0:
            strength = min(max(mean * (1 - mean) / var - 1, 1.0), rules.max_strength)
        rates.append(
            ((F.col(rule) + mean * strength) / (F.col("n") + strength)).alias(f"{rule}_rate")
        )
    return hosts.select("host", "n", *rates)


def rejected_hosts(rates: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    over = F.greatest(*(F.col(f"{rule}_rate") for rule in RULES)) > rules.host_rate
    return rates.filter(over).select("host")


def _with_verdicts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Add `_rejected` to rows by host: by broadcast if the hosts are counted few, else salted."""
    hosts = written(rejected, "rejected-hosts").withColumn("_rejected", F.lit(True))
    if hosts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hosts), "host", "left")
    salt = F.floor(F.rand(7) * SALTS).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("_salt", salt)
    return dealt.join(hosts.withColumn("_salt", salts), ["host", "_salt"], "left").drop("_salt")


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), *, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that pass, with all their columns; nothing but host counts is shuffled."""
    whole = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(host).alias("host"), F.col(text).alias("text")
    )
    # the rows are stored with their tests, as both the host counts and the filter ask for them
    tests = F.struct(*(F.expr(test).alias(rule) for rule, test in _failed(rules).items()))
    figures = written(word_figures(whole, keep=("row", "host")).select("row", "host", tests.alias("tests")), "quality-tests")
    rejected = rejected_hosts(host_rates(figures, rules), rules)
    base = F.col("tests.short") | F.col("tests.repeated")
    good = _with_verdicts(figures.select("row", "host", base.alias("_base")), rejected).filter(~F.col("_base") & F.col("_rejected").isNull())
    return good.select("row.*")


def judge(
    docs: DataFrame,
    rules: HostRules = HostRules(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """(doc_id, figures..., base_failed, host_failed, kept), one row per input row.

    The figures are written once: counting by host and the join back both read them.
    """
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")
    )
    figures = written(word_figures(picked, keep=("doc_id", "host")), "quality-figures")
    joined = _with_verdicts(figures, rejected_hosts(host_rates(figures, rules), rules))
    failed = _failed(rules)
    base = F.expr(f"({failed['short']}) OR ({failed['repeated']})")
    host_failed = F.coalesce("_rejected", F.lit(False))
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        host_failed.alias("host_failed"),
        (~base & ~host_failed).alias("kept"),
    )
