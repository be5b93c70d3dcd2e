"""Terms counted by numpy over batches of texts, where no row per posting is wanted.

The terms are those of `terms.term_arrays`, which stays the definition and the way to a forward
index. Lower case is Spark's, and which characters make words is asked of Spark's own regular
expressions, so both ways agree on every character. Term texts are compared, never hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmere.functions.text import NOT_WORD
from lexmere.operators.packed import PACKED, grouped, groups_of, joined_hash, pack, sliced, word_hashes
from lexmere.operators.terms import TermOptions

CHUNK = 8 << 20  # bytes of text counted together, unless one text is longer
OUT_ROWS = 200_000
STATS_ROWS = 1_000_000  # statistics rows that are packed together
LIST_CHUNK = 32 << 20  # the same where terms are packed: fewer terms come twice in larger batches
CODE_POINTS = 0x110000

_characters: dict[tuple[str, str], bytes] = {}


def _matching(spark: SparkSession, pattern: str) -> bytes:
    """One bit for each code point: whether `pattern` is not found in "a", the character and
    "A". Asked once a session."""
    key = (spark.sparkContext.applicationId, pattern)
    if key not in _characters:
        points = spark.range(CODE_POINTS).filter("id < 55296 OR id > 57343")  # no halves of pairs
        # behind a letter, as a byte order mark in front would be taken out
        character = F.decode(F.unhex(F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"), F.lit("00000041"))), "UTF-32")
        inside = np.zeros(CODE_POINTS, bool)
        inside[[r["id"] for r in points.filter(~character.rlike(pattern)).collect()]] = True
        _characters[key] = np.packbits(inside).tobytes()
    return _characters[key]


def word_characters(spark: SparkSession) -> bytes:
    """One bit for each code point: whether it belongs to a word."""
    return _matching(spark, NOT_WORD)


def joining_characters(spark: SparkSession) -> bytes:
    """One bit for each code point: whether no word begins behind it."""
    return _matching(spark, r"(?U)\bA\z")


class Batch:
    """Words of some texts: a code for each, the texts of the codes, the row it is in."""

    def __init__(self, texts: pa.StringArray, inside: np.ndarray, drop: pa.StringArray, fold: np.ndarray | None = None) -> None:
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("\n".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
        if fold is not None:
            points = fold[points]
        mask = inside[points]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        kept = points[mask]
        sizes = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(ends - starts)))].astype(np.int32)
        data = kept.tobytes().decode("utf-32-le").encode()
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = words.dictionary_encode()
        self.texts = coded.dictionary
        code = coded.indices.to_numpy().astype(np.int64)
        row = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
        used = pc.and_(pc.greater(pc.utf8_length(self.texts), 1), pc.invert(pc.is_in(self.texts, value_set=drop)))
        used = used.to_numpy(zero_copy_only=False).astype(bool)[code]
        self.code, self.row = code[used], row[used]
        self.words = np.bincount(self.row, minlength=len(texts))

    def n_terms(self, low: int, high: int) -> np.ndarray:
        return sum(np.maximum(self.words - n + 1, 0) for n in range(low, high + 1))

    def keep(self, used: np.ndarray, least: int) -> None:
        """Leave out all words but those of the flagged codes, then rows of fewer than `least`."""
        used = used[self.code]
        self.code, self.row = self.code[used], self.row[used]
        used = (np.bincount(self.row, minlength=len(self.words)) >= least)[self.row]
        self.code, self.row = self.code[used], self.row[used]
        self.words = np.bincount(self.row, minlength=len(self.words))

    def ordered(self, low: int, high: int, place: np.ndarray, places: int, known: np.ndarray | None = None) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Terms of each length, sorted by their words: (texts, hashes, n, place, count), where
        a term has `n` of the (place, count) pairs, by place. `place` is a number below
        `places` for each row; equal ones are counted together. With `known`, one flag for
        each word code, only terms of known words."""
        usable = np.ones(len(self.code), bool) if known is None else known[self.code]
        order = np.asarray(pc.sort_indices(self.texts)).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = self.texts.take(pa.array(order))
        hashed = word_hashes(words)
        word = rank[self.code]
        kinds, places = max(1, len(words)), max(1, places)
        at, code, texts, hashes = np.flatnonzero(usable), word[usable], words, hashed
        for n in range(1, high + 1):
            if n > 1:
                last = at + n - 1
                ok = last < len(word)
                at, code, last = at[ok], code[ok], last[ok]
                ok = (self.row[at] == self.row[last]) & usable[last]
                at, code, last = at[ok], code[ok], last[ok]
                pair = code * kinds + word[last]
                if n < high or kinds * len(texts) * places >= 1 << 62:
                    pair, code = np.unique(pair, return_inverse=True)
                    front, back = pair // kinds, pair % kinds
                else:
                    front, code = None, pair
            if n >= low:
                both, count = np.unique(code * places + place[self.row[at]], return_counts=True)
                code_of = both // places
                first = np.flatnonzero(np.diff(code_of, prepend=-1))
                seen = code_of[first]
                if n == 1:
                    found, found_hashes = texts.take(pa.array(seen)), hashes[seen]
                else:
                    a, b = (seen // kinds, seen % kinds) if front is None else (front[seen], back[seen])
                    found, found_hashes = _joined(texts, words, a, b), joined_hash(hashes[a], hashed[b])
                yield found, found_hashes, np.diff(first, append=len(both)), both % places, count
            if n > 1 and n < high:
                texts, hashes = _joined(texts, words, front, back), joined_hash(hashes[front], hashed[back])

    def grams(self, low: int, high: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]]:
        """(row, code, tf) of every term of each length, and the texts of the codes.

        With `known`, one flag for each word code, only terms of known words.
        """
        kinds = max(1, len(self.texts))
        usable = np.ones(len(self.code), bool) if known is None else known[self.code]
        at, code, texts = np.flatnonzero(usable), self.code[usable], self.texts
        for n in range(1, high + 1):
            if n > 1:
                ok = at + n - 1 < len(self.code)
                at, code = at[ok], code[ok]
                last = at + n - 1
                ok = (self.row[at] == self.row[last]) & usable[last]
                at, code, last = at[ok], code[ok], last[ok]
                pairs = pa.array(code * kinds + self.code[last]).dictionary_encode()
                pair = pairs.dictionary.to_numpy()
                code = pairs.indices.to_numpy().astype(np.int64)
                texts = pc.binary_join_element_wise(texts.take(pa.array(pair // kinds)), self.texts.take(pa.array(pair % kinds)), " ")
            if n >= low:
                size = max(1, len(texts))
                both, tf = np.unique(self.row[at] * size + code, return_counts=True)
                yield both // size, both % size, tf, texts


def _joined(front: pa.StringArray, words: pa.StringArray, a: np.ndarray, b: np.ndarray) -> pa.StringArray:
    return pc.binary_join_element_wise(front.take(pa.array(a)), words.take(pa.array(b)), " ")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Record batches joined and cut to about `size` bytes of `text`."""
    held, held_bytes = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size - held_bytes, side="right")))
            held.append(batch.slice(first, last - first))
            held_bytes += int(ends[last - 1] - done)
            first = last
            if held_bytes >= size or last < len(batch):
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def _batches(batches: Iterator[pa.RecordBatch], inside: bytes, drop: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Record batches cut to about CHUNK bytes of `text`, each with its words."""
    table = np.unpackbits(np.frombuffer(inside, np.uint8)).astype(bool)
    dropped = pa.array(drop, pa.string())
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            part = batch.slice(first, last - first)
            yield part, Batch(part["text"], table, dropped)
            first = last


def _sliced(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for at in range(0, len(whole), OUT_ROWS):
        yield whole.slice(at, OUT_ROWS)


def _source(text: str, options: TermOptions):
    """Like the source of `term_arrays`; Python only takes valid UTF-8."""
    source = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    return (F.lower(source) if options.lowercase else source).alias("text")


def text_stats(docs: DataFrame, text: str, options: TermOptions) -> DataFrame:
    """`terms.term_stats` of (doc, `text`): each task counts batches, Spark adds them up."""
    inside, drop = word_characters(docs.sparkSession), options.words_to_drop()
    low, high = _range(options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _batches(batches, inside, drop):
            doc = part["doc"].to_numpy()
            for row, code, tf, texts in words.grams(low, high):
                held = np.zeros(len(texts), np.int64)
                held[code] = doc[row]  # of terms in several rows any one
                found = {
                    "term": texts,
                    "df": pa.array(np.bincount(code, minlength=len(texts))),
                    "cf": pa.array(np.bincount(code, tf, minlength=len(texts)).astype(np.int64)),
                    "only_doc": pa.array(held),
                }
                seen = pc.greater(found["df"], 0)
                yield from _sliced({c: column.filter(seen) for c, column in found.items()})

    parts = docs.select("doc", _source(text, options)).mapInArrow(count, "term string, df long, cf long, only_doc long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("only_doc").alias("only_doc"))


def asked_rows(docs: DataFrame, text: str, options: TermOptions, keep: list[str], terms: list[str]) -> DataFrame:
    """`terms.term_rows` of (`keep`..., `text`), the rows of `terms` only."""
    spark = docs.sparkSession
    inside, drop = word_characters(spark), options.words_to_drop()
    low, high = _range(options)
    wanted = spark.sparkContext.broadcast(terms)
    out = StructType(docs.select(*keep).schema.fields).add("n_terms", "integer").add("term", "string").add("tf", "integer")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(wanted.value, pa.string())
        parts = pa.array(sorted({w for t in wanted.value for w in t.split(" ")}), pa.string())
        for part, words in _batches(batches, inside, drop):
            known = pc.is_in(words.texts, value_set=parts).to_numpy(zero_copy_only=False).astype(bool)
            n_terms = words.n_terms(low, high)
            for row, code, tf, texts in words.grams(low, high, known):
                hit = pc.is_in(texts, value_set=listed).to_numpy(zero_copy_only=False).astype(bool)[code]
                row, code, tf = row[hit], code[hit], tf[hit]
                columns = {c: part[c].take(pa.array(row)) for c in keep}
                columns |= {"n_terms": pa.array(n_terms[row], pa.int32()), "term": texts.take(pa.array(code)), "tf": pa.array(tf, pa.int32())}
                yield from _sliced(columns)

    return docs.select(*keep, _source(text, options)).mapInArrow(count, out)


def posting_lists(docs: DataFrame, text: str, options: TermOptions, folders: int, parts: int = 1) -> DataFrame:
    """Packed lists (term, held array<struct<at, tf>>) of (doc, `text`): `at` and the packed
    row's `base` add up to the document. A folder's terms lie in `parts` groups."""
    inside, drop = word_characters(docs.sparkSession), options.words_to_drop()
    low, high = _range(options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(inside, np.uint8)).astype(bool)
        dropped = pa.array(drop, pa.string())
        for part in gathered(batches, LIST_CHUNK):
            words = Batch(part["text"], table, dropped)
            doc = part["doc"].to_numpy()
            order = np.argsort(doc, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            base, at = int(doc.min()), doc[order] - doc.min()
            for texts, hashes, n, row, tf in words.ordered(low, high, place, len(doc)):
                held = pa.StructArray.from_arrays([pa.array(at[row]), pa.array(tf.astype(np.int32))], ["at", "tf"])
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.RecordBatch.from_arrays([texts, pa.ListArray.from_arrays(pa.array(offsets), held)], names=["term", "held"])
                group = groups_of(hashes, folders) * parts + groups_of(hashes + np.uint64(1), parts)
                yield from pack(lists, base, group, folders * parts)

    return docs.select("doc", _source(text, options)).mapInArrow(count, PACKED)


STATS = "term string, df long, cf long, docs long"


def stats_table(terms: pa.StringArray, df: np.ndarray, cf: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(df.astype(np.int64)), pa.array(cf.astype(np.int64)), pa.array(docs)], names=["term", "df", "cf", "docs"])


def packed_stats(docs: DataFrame, text: str, options: TermOptions, groups: int, sign: int = 1) -> DataFrame:
    """Packed (term, df, cf, docs) of (doc, `text`), `docs` being the exclusive or of the
    documents; with sign -1, what their removal changes."""
    inside, drop = word_characters(docs.sparkSession), options.words_to_drop()
    low, high = _range(options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(inside, np.uint8)).astype(bool)
        dropped = pa.array(drop, pa.string())
        for part in gathered(batches, LIST_CHUNK):
            words, doc = Batch(part["text"], table, dropped), part["doc"].to_numpy()
            for texts, _, n, row, tf in words.ordered(low, high, np.arange(len(doc)), len(doc)):
                if len(texts):
                    first = np.cumsum(n) - n
                    held = stats_table(texts, sign * n, sign * np.add.reduceat(tf, first), np.bitwise_xor.reduceat(doc[row], first))
                    yield from pack(held, 0, groups_of(word_hashes(texts), groups), groups)

    return docs.select("doc", _source(text, options)).mapInArrow(count, PACKED)


def repacked_stats(stats: DataFrame, groups: int) -> DataFrame:
    """Rows of STATS as packed tables."""

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in _ended(batches):
            if batch is not None:
                held.append(batch)
                rows += len(batch)
            if held and (batch is None or rows >= STATS_ROWS):
                whole = pa.concat_batches(held)
                yield from pack(whole, 0, groups_of(word_hashes(whole["term"]), groups), groups)
                held, rows = [], 0

    return stats.select("term", "df", "cf", "docs").mapInArrow(repack, PACKED)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def merged_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of STATS for each term of packed tables that lie group by group."""
    for _, tables in grouped(batches):
        held = pa.concat_batches([t for _, t in tables])
        coded = held["term"].dictionary_encode()
        sorted_ = pc.sort_indices(coded.dictionary)  # packs well
        rank = np.empty(len(sorted_), np.int64)
        rank[sorted_.to_numpy()] = np.arange(len(sorted_))
        code = rank[coded.indices.to_numpy()]
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums = (np.add.reduceat(held[c].to_numpy()[order], first) for c in ("df", "cf"))
        merged = stats_table(coded.dictionary.take(sorted_), *sums, np.bitwise_xor.reduceat(held["docs"].to_numpy()[order], first))
        yield from sliced(dict(zip(merged.schema.names, merged.columns)))


def _range(options: TermOptions) -> tuple[int, int]:
    low, high = options.ngram_range
    if not 1 <= low <= high:
        raise ValueError(f"bad ngram_range: {options.ngram_range}")
    return low, high
