"""Text expressions: Column in, Column out, all evaluated in the JVM.

The intended semantics are those of Unicode-aware regular expressions: `\\s`
covers every white-space code point (and U+001C-001F), `\\d` every decimal digit.
Java needs the (?U) flag for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def clean(c: Column) -> Column:
    """Collapse white space (no-break space included) to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def clean_lines(c: Column) -> Column:
    """array<string>: each line cleaned, blank lines dropped."""
    return F.filter(F.transform(F.split(c, "\n", -1), clean), lambda x: F.length(x) > 0)


def paragraphs(c: Column, min_chars: int = 80) -> Column:
    """array<string>: blank-line separated blocks, cleaned, short ones dropped."""
    blocks = F.split(c, rf"(?U)\n{WS}*\n", -1)
    return F.filter(F.transform(blocks, clean), lambda p: F.length(p) >= min_chars)


def sentences(c: Column) -> Column:
    """array<string>: split after Japanese or English end marks plus white space."""
    whole = strip(c)
    parts = F.split(whole, rf"(?U)(?<=[。．.!?]){WS}+", -1)
    kept = F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(whole))


def lines(c: Column) -> Column:
    """array<string>: non-blank lines, stripped; every Unicode line end counts."""
    parts = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def units(c: Column, unit: str = "sentence") -> Column:
    """Evaluation units: lines for unit='line', sentences for anything else."""
    return lines(c) if unit == "line" else sentences(c)


def normal_key(c: Column) -> Column:
    """Dictionary key form: stripped, lower case, single blanks."""
    return F.regexp_replace(F.lower(strip(c)), rf"(?U){WS}+", " ")


def normal_long(c: Column) -> Column:
    """Long form: single blanks, no blank or ,.;: at either end."""
    return F.btrim(clean(c), F.lit(" ,.;:"))


def page_of(chunk_id: Column) -> Column:
    """Page number held in a chunk id, 0 when there is none."""
    digits = F.regexp_extract(chunk_id, r"::p(\d+)::", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))


def topic_of_path(path: Column) -> Column:
    """Folder after the first `papers` part of a path, else `misc`."""
    parts = F.split(path, "/", -1)
    at = F.array_position(parts, "papers")
    return F.when(at > 0, F.coalesce(F.get(parts, at.cast("int")), F.lit("misc"))).otherwise("misc")


def topic_list(raw: Column, missing: tuple[str, ...] = ("__unknown__",)) -> Column:
    """array<string> from a topic that was read as JSON text: list, scalar or null.

    `raw` holds the list as JSON text (`["a"]`) or the bare scalar.
    """
    default = F.array(*[F.lit(m) for m in missing]).cast("array<string>")
    as_list = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    parsed = F.when(as_list.isNotNull(), as_list).otherwise(F.array(raw))
    return F.when(raw.isNull() | (F.size(parsed) == 0), default).otherwise(parsed)


def python_list(items: Column) -> Column:
    """['a', 'b'] as the context header prints a topic list."""
    quoted = F.transform(
        items,
        lambda x: F.when(
            x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def printed(value: Column, digits: int) -> Column:
    """A double with a fixed number of decimals, rounded half to even on its exact value.

    The part after the point is m / 2**s with whole m and s, so it is compared with the
    places between decimals in whole numbers. For values below 2**63; a part after the
    point below 1e-12 counts as none.
    """
    x = F.abs(value)
    whole = F.floor(x)
    part = x - whole.cast("double")  # exact
    tiny = part < 1e-12
    # m below 2**54, so that it is whole; powers of two scale a double exactly
    s = F.lit(53) - F.floor(F.log2(F.when(tiny, F.lit(0.5)).otherwise(part))).cast("int")
    m = (part * F.pow(F.lit(2.0), s.cast("double"))).try_cast("long").cast("decimal(19,0)")
    one = F.lit(1).cast("long")
    low, high = (F.call_function("shiftleft", one, n).cast("decimal(15,0)") for n in (F.least(s, F.lit(47)), F.greatest(s - 47, F.lit(0))))
    scale = low * high  # 2 ** s
    top = m * F.lit(10**digits).cast(f"decimal({digits + 1},0)")
    kept = F.call_function("div", top, scale)
    twice = 2 * (top % scale)
    up = (twice > scale) | ((twice == scale) & (kept % 2 == 1))
    number = F.when(tiny, F.lit(0)).otherwise(kept + up.cast("int"))
    carry = (number == 10**digits).cast("long")
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        (whole + carry).cast("string"),
        F.lit("."),
        F.lpad((number % 10**digits).cast("string"), digits, "0"),
    )
    endless = F.when(F.isnan(value), F.lit("nan")).when(x == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    return F.when(F.isnan(value) | (x == float("inf")), endless).otherwise(text)


def long_words(words: str, drop: tuple[str, ...], also: str = "true") -> Column:
    """Words of two characters or more that are not in `drop` and pass the SQL test `also`.

    The list goes to the JVM as one expression: one call instead of one per word.
    """
    if not drop:
        return F.expr(f"filter({words}, w -> length(w) > 1 AND {also})")
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in drop)
    return F.expr(f"filter({words}, w -> length(w) > 1 AND {also} AND w NOT IN ({quoted}))")
