"""SentencePiece encoding and decoding by suffix-array matching, equal to the library's ids.

The text to encode is concatenated and its suffixes are sorted, as far as the longest piece
reaches. Each piece is then binary-searched for the range of suffixes that begin with it;
all occurrences are the edges of a lattice. Edges are sorted by where they end, and
relaxed in that order for all texts in step: the last token of a prefix's BPE encoding is
the one edge whose token may follow the last token of the prefix it starts from. Two
tokens may follow each other if undoing their merges, latest first, never shows a merge
across their border that BPE would have made earlier. So the path found is BPE's own.

Characters without a piece become one token per UTF-8 byte, as in the model.

Defined cases: a null text is empty and has no ids; rows are encoded one by one, so repeated
rows and null ids come out as often as they go in; an empty table gives no rows. Other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.units import MARK, UnitEncoder

INDEX_CHARS = 200_000
SEPARATOR = 0x110000  # beyond every character
NEVER = np.float64(np.inf)
SLICE_ROWS = 1_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@lru_cache(maxsize=1)
def decoded_pieces(path: str) -> list[bytes]:
    """What each id stands for in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def plain(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece.replace(MARK, " ").encode()

    return [plain(i) for i in range(model.get_piece_size())]


class Pieces:
    """What the matcher needs of a BPE model: pieces, merge order, and each piece's own split."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {}
        self.decoded = decoded_pieces(path)
        strings: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                strings[piece] = i
        self.ids = strings
        order = sorted({-model.get_score(i) for p, i in strings.items() if len(p) > 1})
        place = {s: k for k, s in enumerate(order)}
        # when a piece is merged; single characters are there from the start
        self.rank = np.full(size + 1, -1.0)
        for piece, i in strings.items():
            if len(piece) > 1:
                self.rank[i] = place[-model.get_score(i)]
        self.size = size  # also the token of a character without a piece
        pairs: dict[int, float] = {}
        for piece, i in strings.items():
            for cut in range(1, len(piece)):
                left, right = strings.get(piece[:cut]), strings.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (size + 1) + right] = self.rank[i]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_rank = np.append([pairs[k] for k in keys.tolist()], NEVER)
        self.left = np.arange(size + 1)
        self.right = np.arange(size + 1)
        reachable = []
        for piece, i in strings.items():
            split = self._own_split(piece) if len(piece) > 1 else (i, i)
            if split is not None:
                self.left[i], self.right[i] = split
                reachable.append((piece, i))
        self.longest = max(len(p) for p, _ in reachable)
        self.token = np.array([i for _, i in reachable])
        self.length = np.array([len(p) for p, _ in reachable])
        low = np.zeros((len(reachable), self.longest), np.uint32)
        high = np.full((len(reachable), self.longest), SEPARATOR + 1, np.uint32)
        for k, (piece, _) in enumerate(reachable):
            low[k, : len(piece)] = high[k, : len(piece)] = _codes(piece)
        self.low, self.high = (a.view(f"<U{self.longest}").ravel() for a in (low, high))
        self.char_length = np.ones(size + 1, np.int64)
        self.char_length[self.token] = self.length
        singles = [(ord(p), i) for p, i in strings.items() if len(p) == 1]
        self.single_codes = np.array(sorted(c for c, _ in singles), np.uint32)

    def _own_split(self, piece: str) -> tuple[int, int] | None:
        """The last merge when the piece is encoded alone; None if it is never formed."""
        symbols = list(piece)
        last = None
        while len(symbols) > 1:
            best = None
            for k in range(len(symbols) - 1):
                joined = self.ids.get(symbols[k] + symbols[k + 1])
                if joined is not None and (best is None or self.rank[joined] < best[0]):
                    best = (self.rank[joined], k)
            if best is None:
                return None
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = ["".join(last)]
        return (self.ids[last[0]], self.ids[last[1]]) if all(s in self.ids for s in last) else None

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b can stand right after token a in a BPE encoding."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NEVER)
        while len(live):
            key = a * (self.size + 1) + b
            at = np.searchsorted(self.pair_keys, key)
            merged = np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)
            clash = merged < limit
            good[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # of merges of equal rank the left one comes first, so the right one is undone first
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 0.5)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def occurrences(codes: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece index) of every occurrence of every piece, by binary search."""
    padded = np.concatenate([codes, np.full(model.longest, SEPARATOR, np.uint32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, model.longest)[: len(codes)]
    suffixes = np.ascontiguousarray(windows).view(f"<U{model.longest}").ravel()
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    first = np.searchsorted(suffixes, model.low, "left")
    count = np.searchsorted(suffixes, model.high, "right") - first
    found = np.flatnonzero(count > 0)
    piece = np.repeat(found, count[found])
    step = np.arange(len(piece)) - np.repeat(np.cumsum(count[found]) - count[found], count[found])
    return order[first[piece] + step], piece


def encode_marked(texts: list[str], model: Pieces) -> list[list[int]]:
    """Ids of texts whose spaces are marks already, all in one index."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    codes = np.empty(int(sizes.sum()) + len(texts), np.uint32)
    begins = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(codes), bool)
    body[begins + sizes] = False
    codes[body] = _codes("".join(texts))
    codes[~body] = SEPARATOR
    start, piece = occurrences(codes, model)
    token = model.token[piece]
    lone = np.flatnonzero(body & ~np.isin(codes, model.single_codes))
    start = np.concatenate([start, lone])
    token = np.concatenate([token, np.full(len(lone), model.size)])
    length = model.char_length[token]
    origin = np.repeat(begins, sizes + 1)
    end = start + length
    depth = end - origin[start]
    by_depth = np.argsort(depth, kind="stable")
    start, token, end, depth = start[by_depth], token[by_depth], end[by_depth], depth[by_depth]
    cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    last = np.full(len(codes) + 1, -1, np.int64)  # last token of the prefix that ends here
    opening = origin[start] == start
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        fits = opening[lo:hi].copy()
        inner = np.flatnonzero(~fits)
        if len(inner):
            fits[inner] = model.may_follow(last[start[lo:hi][inner]], token[lo:hi][inner])
        last[end[lo:hi][fits]] = token[lo:hi][fits]
    # walk back from every end in step; tokens come out by text and descending place
    text = np.flatnonzero(sizes)
    at = begins[text] + sizes[text]
    owners, tokens, places = [], [], []
    while len(text):
        mine = last[at]
        if (mine < 0).any():
            raise ValueError("a text has a prefix without an encoding")
        at = at - model.char_length[mine]
        owners.append(text)
        tokens.append(mine)
        places.append(at)
        more = at > begins[text]
        text, at = text[more], at[more]
    owners, tokens, places = (np.concatenate(x) for x in (owners, tokens, places))
    order = np.argsort(places, kind="stable")
    owners, tokens, places = owners[order], tokens[order], places[order]
    out: list[list[int]] = []
    bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        ids = tokens[bounds[k] : bounds[k + 1]].tolist()
        if model.size in ids:
            spots = places[bounds[k] : bounds[k + 1]].tolist()
            ids = [
                i
                for token, spot in zip(ids, spots)
                for i in (
                    [token] if token < model.size else [model.bytes[b] for b in chr(codes[spot]).encode()]
                )
            ]
        out.append(ids)
    return out


class SuffixEncoder(UnitEncoder):
    """Whole texts by parts, each different part matched once per index."""

    def __init__(self, path: str):
        super().__init__("pieces", path)
        self._library = self._match
        self.model = pieces(path)

    def _match(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        run: list[str] = []
        size = 0
        for part in parts:
            run.append(MARK + part.replace(" ", MARK) if part else "")
            size += len(part) + 2
            if size > INDEX_CHARS:
                out.extend(encode_marked(run, self.model))
                run, size = [], 0
        out.extend(encode_marked(run, self.model))
        return out


@lru_cache(maxsize=1)
def suffix_encoder(path: str) -> SuffixEncoder:
    return SuffixEncoder(path)


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, ids): `ids` are little-endian unsigned 32-bit numbers. No shuffle.

    A null text counts as empty and has no ids; rows are encoded one by one whatever their
    ids; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = suffix_encoder(path)
        for batch in batches:
            ids = pa.array(list(encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["doc_id", "text", "ids"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, text string, ids binary")


def _decoded(ids: bytes | None, known: list[bytes]) -> str:
    """Marks become spaces, the first one goes."""
    data = b"".join(map(known.__getitem__, memoryview(ids or b"").cast("I")))
    return data.removeprefix(b" ").decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add `decoded`: the text of the ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoded_pieces(path)
        for batch in batches:
            texts = [_decoded(ids, known) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, ids, decoded): `encode` and `decode` in one worker, a slice of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = suffix_encoder(path)
        known = encoder.model.decoded
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = list(encoder.encode(part.column(1).cast(pa.binary()).to_pylist()))
                decoded = pa.array([_decoded(i, known) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), decoded], ["doc_id", "text", "ids", "decoded"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, text string, ids binary, decoded string")
