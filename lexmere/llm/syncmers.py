"""Document fingerprints from closed syncmers, in SQL expressions only.

A text's units are its words; a character of a script written without spaces is a unit of
its own, and so is each character of a run of more than LONG_UNIT characters. Of all windows of K units (k-mers) those are anchors whose smallest hashed inner
window of S units (s-mer) is the first or the last. Whether a k-mer is an anchor depends
on nothing outside it, so the same passage yields the same anchors in any text, and at
least one anchor starts in any K - S + 1 successive places. A text with fewer places may
have none: with `fill`, as in the query, every unit is then an anchor, so that only a text
without units has none at all; without it such a text counts as an empty one.

The fingerprint lists the anchors' 31-bit hashes in text order, as eight hexadecimal digits.
The likeness of two fingerprints is the Dice coefficient of their anchor sets.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint, and
two empty ones are alike (1.0); a text of fewer than K units has every unit as an anchor;
white space alone counts as empty; other columns are ignored. Rows of equal doc_id share their neighbours in doc_id order; as
somebody's next document, the one with the smallest head counts. A null doc_id sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import documents, outer_id
from lexmere.session import written

K = 5
S = 2
LONG_UNIT = 4096  # characters; a longer run is no word, and an edit would change all of it
# Thai, Lao, Myanmar, Khmer, kana and Han by code ranges; script properties cost far more.
SPACELESS = (
    r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF"
    r"\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
)
BEYOND = r"[\u0E00-\x{10FFFF}]"  # one comparison per character finds texts that may hold some


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S, fill: bool = False) -> DataFrame:
    """Add array<int> column `out`: the anchors of `text`, in order. No shuffle.

    Every stage is a projection of its own, so that nothing is computed once per element.
    """
    if not 1 <= s < k:
        raise ValueError("an inner window is shorter than its k-mer")
    keep = [f"`{c}`" for c in df.columns]
    spaced = f"IF({text} rlike r'{BEYOND}', regexp_replace({text}, r'({SPACELESS})', ' $1 '), {text})"
    units = df.selectExpr(*keep, rf"array_remove(split({spaced}, r'[\x20\x09-\x0D]+', -1), '') AS _u")
    single = f"flatten(transform(_u, u -> IF(char_length(u) > {LONG_UNIT}, split(u, ''), array(u))))"
    runs = f"octet_length({text}) > {LONG_UNIT} AND exists(_u, u -> char_length(u) > {LONG_UNIT})"
    units = units.selectExpr(*keep, f"IF({runs}, {single}, _u) AS _u")
    hashed = units.selectExpr(*keep, "transform(_u, u -> xxhash64(u)) AS _h")
    inner = hashed.selectExpr(*keep, "_h", f"{_windows('_h', s)} AS _i")
    mers = ", ".join(f"w.`{j}`" for j in range(s))
    inner = inner.selectExpr(*keep, "_h", f"transform(_i, w -> xxhash64({mers})) AS _s")
    width = k - s + 1
    outer = inner.selectExpr(*keep, "_h", f"{_windows('_s', width)} AS _w")
    parts = [f"w.`{j}`" for j in range(width)]
    anchors = f"""transform(filter(_w, w -> least({', '.join(parts)}) IN ({parts[0]}, {parts[-1]})),
                            w -> cast(xxhash64({', '.join(parts)}) & 2147483647L AS int))"""
    few = "transform(_h, h -> cast(h & 2147483647L AS int))"
    found = outer.selectExpr(*keep, "_h", f"{anchors} AS _a")
    none = "size(_a) = 0" if fill else f"size(_h) < {k}"
    return found.selectExpr(*keep, f"IF({none}, {few}, _a) AS {out}")


def _windows(array: str, width: int) -> str:
    """All windows of an array as structs with fields 0, 1, ..., walked in step."""
    n = f"greatest(size({array}) - {width - 1}, 0)"
    return f"arrays_zip({', '.join(f'slice({array}, {j + 1}, {n})' for j in range(width))})"


def fingerprint(anchors: str) -> Column:
    return F.expr(f"array_join(transform({anchors}, a -> lpad(hex(a), 8, '0')), '')")


def likeness(one: str, two: str) -> Column:
    """Dice coefficient of two anchor sets, 1.0 for two empty ones."""
    sizes = F.size(F.array_distinct(one)) + F.size(F.array_distinct(two))
    return F.when(sizes == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, two)) / sizes)


def followers(sizes: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars): who comes before each id; the last before the first.

    Ids alone are range-partitioned and stored with their partition's number; windows stay
    within a partition, and the last id of each partition, one row, links it to the next.
    """
    dealt = sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "document-order")
    ends = dealt.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("end"))
    ends = sorted((r["part"], r["end"]["doc_id"], r["end"]["n_chars"]) for r in ends.collect())
    links = [(part, ends[i - 1][1], ends[i - 1][2]) for i, (part, _, _) in enumerate(ends)]
    before = dealt.sparkSession.createDataFrame(links, "part int, end_id long, end_chars long")
    order = Window.partitionBy("part").orderBy("doc_id")
    return dealt.join(F.broadcast(before), "part").select(
        "doc_id",
        F.coalesce(F.lag("doc_id").over(order), "end_id").alias("prev_id"),
        F.coalesce(F.lag("n_chars").over(order), "end_chars").alias("prev_chars"),
    )


def edited_fingerprints(docs: DataFrame, *, fill: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited text and the next document's.

    The edited text has its last quarter replaced by as many characters from the start of
    the next document. A document sends its own head and anchors to the one before it.
    """
    texts = documents(docs, doc_id, text)
    sizes = texts.groupBy("doc_id").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"))
    order = written(followers(written(sizes, "document-sizes")), "document-followers")
    sent = texts.join(order.hint("merge"), "doc_id")
    sent = with_anchors(sent, "text", "next_anchors", fill=fill).select(
        F.col("prev_id").alias("doc_id"),
        F.expr("substring(text, 1, cast(floor(prev_chars / 4) AS int))").alias("head"),
        "next_anchors",
    )
    sent = sent.groupBy("doc_id").agg(F.min(F.struct("head", "next_anchors")).alias("next"))
    both = texts.join(sent.hint("merge"), "doc_id")
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.selectExpr(
        "doc_id",
        "n_chars",
        "text",
        """concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int)),
                  substring(next.head, 1, cast(floor(n_chars / 4) AS int))) AS edited""",
        "next.next_anchors AS next_anchors",
    )
    both = with_anchors(with_anchors(both, "text", "anchors", fill=fill), "edited", "edited_anchors", fill=fill)
    return both.select(
        outer_id("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
