"""Exact token ids of whole texts from the token ids of their space-separated parts.

Encoding one text after the other repeats the work for every frequent word. Each public
tokenizer used here has places that no token can cross, whatever surrounds them, so a text
may be cut there and each different part encoded once:

words   `word_bpe_49k`: white space is dropped before BPE; cut at ASCII white space.
bytes   `byte_bpe_50k`: a run that ends before a space never takes the space in; cut
        before a space that follows a visible character.
pieces  `piece_bpe_32k`: no vocabulary piece holds another character before a space mark;
        cut before a space that follows anything but a space or a literal mark.

A part that does not allow its cut is glued to the next one. Texts are cut and looked up in
runs: their different parts are found by Arrow, and ids are gathered per run with numpy.
Short parts are remembered for later runs by a 128-bit hash, with their ids in one array; a
full memory takes no new parts, so its size is bounded.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

CACHE_PARTS = 700_000
LONGEST_CACHED = 64
SLICE_BYTES = 4_000_000
JOINED_PARTS = 4_000
MARK = "▁"
FENCES = "§¶¤¦¬°±×÷"  # characters one of which may stand between words and be found again


BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True


def _array(data: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Byte strings of the given sizes that lie one after the other in `data`."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def slices(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about SLICE_BYTES together; a null text is an empty one."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append(text or b"")
        size += len(run[-1])
        if size >= SLICE_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


class Remembered:
    """Ids of parts by the parts' hashes: sorted hashes beside places in one array of ids."""

    def __init__(self) -> None:
        self.high = np.zeros(0, np.uint64)
        self.low = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.high)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place) of each hash."""
        at = np.minimum(np.searchsorted(self.high, hashes[:, 0]), max(0, len(self) - 1))
        if not len(self):
            return np.zeros(len(hashes), bool), at
        return (self.high[at] == hashes[:, 0]) & (self.low[at] == hashes[:, 1]), at

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take in new parts, those whose first hash is taken excepted."""
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        high = np.concatenate([self.high, hashes[:, 0]])
        order = np.argsort(high, kind="stable")
        order = order[np.concatenate(([True], np.diff(high[order]) != 0))] if len(order) else order
        self.high = high[order]
        self.low = np.concatenate([self.low, hashes[:, 1]])[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])


def _hashes(parts: list[bytes]) -> np.ndarray:
    digests = b"".join(map(xxhash.xxh3_128_digest, parts))
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def _joined_ids(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their sizes."""
    ids, sizes = array("I"), array("q")
    for one in lists:
        ids.extend(one)
        sizes.append(len(one))
    return np.frombuffer(ids, "<u4"), np.frombuffer(sizes, np.int64)


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of `ids`, one after the other."""
    moved = starts - (np.cumsum(sizes) - sizes)
    return ids[np.repeat(moved, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(maxsize=1)
def unit_encoder(kind: str, path: str) -> "UnitEncoder":
    """The encoder of this Python worker, kept from task to task."""
    return UnitEncoder(kind, path)


class UnitEncoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, kind: str, path: str):
        self.kind = kind
        self.first = Remembered()
        self.later = Remembered()
        if kind == "pieces":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library: Callable = lambda parts: model.encode(parts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self._library = lambda parts: [
                e.ids for e in model.encode_batch_fast(parts, add_special_tokens=False)
            ]
            if kind == "bytes":  # a token has one letter per byte
                vocabulary = model.get_vocab()
                self._token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
                self._token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._fence: tuple[str, int] | None = None
        if kind == "words":
            single = [(c, self._library([c])[0]) for c in FENCES]
            self._fence = next(((c, ids[0]) for c, ids in single if len(ids) == 1), None)
        if kind == "pieces":  # what the model makes of a space on its own
            self._lone_space = [model.piece_to_id(MARK)]

    def _glue(self, parts: list[bytes]) -> list[bytes]:
        """Put parts together whose cut is not proven."""
        glued, held = [], parts[0]
        for part in parts[1:]:
            if self._open(held):
                held = held + b" " + part
            else:
                glued.append(held)
                held = part
        return [*glued, held]

    def _open(self, part: bytes) -> bool:
        """True if no cut is proven between this part and the space after it."""
        if not part:
            return True
        if self.kind == "pieces":
            return part.endswith(b"\xe2\x96\x81") or part[-1] == 32
        last = part[-1]
        if last < 128:
            return last <= 32
        return part[-4:].decode("utf-8", "ignore")[-1:].isspace()

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that may stand in a row: encoded as one text, cut by tokens' bytes."""
        every, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), JOINED_PARTS):
            run = parts[at : at + JOINED_PARTS]
            ids = np.array(self._library([" " + b" ".join(run).decode()])[0], "<u4")
            ends = np.cumsum([len(p) + 1 for p in run])
            reached = np.cumsum(self._token_bytes[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                raise ValueError("a token crosses a border between parts")
            every.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(every), np.concatenate(sizes)

    def _fenced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without the fence character: one text, with fences between them.

        White space ends a token, and only the fence itself gives the fence's token.
        """
        fence, token = self._fence
        every, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        texts = [words[at : at + JOINED_PARTS] for at in range(0, len(words), JOINED_PARTS)]
        for run, ids in zip(texts, self._library([f" {fence} ".join(w.decode() for w in run) for run in texts])):
            found = np.array(ids, "<u4")
            places = np.flatnonzero(found == token)
            if len(places) != len(run) - 1:
                raise ValueError("a word holds the fence")
            every.append(found[found != token])
            sizes.append(np.diff(np.concatenate(([-1], places, [len(found)]))) - 1)
        return np.concatenate(every), np.concatenate(sizes)

    def _encode(self, parts: list[bytes], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each part has."""
        together: Callable | None = None
        if self._fence is not None:
            mark = self._fence[0].encode()
            together, apart = self._fenced, np.array([mark in p for p in parts], bool)
        elif self.kind == "bytes" and not first:
            together, apart = self._joined, np.array([self._open(p) for p in parts], bool)
        if together is not None:
            rest = [p for p, a in zip(parts, apart) if a]
            lead = " " if self.kind == "bytes" else ""
            some, some_sizes = together([p for p, a in zip(parts, apart) if not a])
            others, other_sizes = _joined_ids(self._library([lead + p.decode() for p in rest]) if rest else [])
            if not rest:
                return some, some_sizes
            sizes = np.zeros(len(parts), np.int64)
            sizes[~apart], sizes[apart] = some_sizes, other_sizes
            starts = np.zeros(len(parts), np.int64)
            starts[~apart] = np.cumsum(some_sizes) - some_sizes
            starts[apart] = len(some) + np.cumsum(other_sizes) - other_sizes
            return _gather(np.concatenate([some, others]), starts, sizes), sizes
        lists = self._library([p.decode() for p in parts])
        if self.kind == "pieces" and not first:
            lists = [self._lone_space if not p else ids for p, ids in zip(parts, lists)]
        return _joined_ids(lists)

    def _looked_up(self, cache: Remembered, parts: list[bytes], first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of different parts; new ones are encoded and remembered."""
        hashes = _hashes(parts)
        known, at = cache.find(hashes)
        new = np.flatnonzero(~known)
        starts, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if known.any():
            starts[known], sizes[known] = cache.start[at[known]], cache.size[at[known]]
        if not len(new):
            return cache.ids, starts, sizes
        unknown = [parts[i] for i in new.tolist()]
        ids, new_sizes = self._encode(unknown, first)
        new_starts = np.cumsum(new_sizes) - new_sizes
        starts[new], sizes[new] = len(cache.ids) + new_starts, new_sizes
        every = np.concatenate([cache.ids, ids])
        if len(cache) < CACHE_PARTS:
            # an open part stands alone only at the end of a text
            short = [len(p) <= LONGEST_CACHED and (self.kind == "words" or not self._open(p)) for p in unknown]
            kept = np.flatnonzero(short)
            cache.add(hashes[new[kept]], _gather(ids, new_starts[kept], new_sizes[kept]), new_sizes[kept])
        return every, starts, sizes

    def _gathered(self, cache: Remembered, parts: pa.Array, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each part has."""
        coded = parts.dictionary_encode()
        places = coded.indices.to_numpy()
        ids, starts, sizes = self._looked_up(cache, coded.dictionary.to_pylist(), first)
        each = sizes[places]
        return _gather(ids, starts[places], each), each

    def _words(self, run: list[bytes]) -> Iterator[bytes]:
        sizes = np.array([len(t) + 1 for t in run], np.int64)
        data = np.frombuffer(b" ".join(run) + b" ", np.uint8)
        inside = ~BLANK[data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ids, each = self._gathered(self.later, _array(data[inside], ends - starts), False)
        # words before the end of each text, then ids before it
        bounds = np.concatenate(([0], np.cumsum(each)))[np.searchsorted(starts, np.cumsum(sizes))]
        yield from _slices(ids, bounds)

    def _spaced(self, run: list[bytes]) -> Iterator[bytes]:
        """Texts as their first parts and the parts after a space."""
        data = np.frombuffer(b"".join(run), np.uint8)
        text_ends = np.cumsum([len(t) for t in run])
        spaces = np.flatnonzero(data == 32)
        before = np.searchsorted(spaces, text_ends)  # spaces up to the end of each text
        # a part ends at a space or with its text
        part_ends = np.sort(np.concatenate([spaces, text_ends]), kind="stable")
        letters = np.concatenate(([0], np.cumsum(data != 32)))
        sizes = np.diff(letters[part_ends], prepend=0)
        parts = _array(data[data != 32], sizes)
        last = before + np.arange(len(run))  # number of each text's last part
        begins = np.concatenate(([0], last[:-1] + 1))
        open_texts: set[int] = set()
        coded = parts.dictionary_encode()
        unproven = np.array([self._open(p) for p in coded.dictionary.to_pylist()], bool)
        if unproven.any():
            at = np.flatnonzero(unproven[coded.indices.to_numpy()])
            at = at[~np.isin(at, last)]  # nothing follows the last part
            open_texts = set(np.searchsorted(last, at).tolist())
        later = np.ones(len(sizes), bool)
        later[begins] = False
        ids, each = self._gathered(self.later, parts.filter(pa.array(later)), False)
        bounds = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(later)[last]))]
        heads, head_each = self._gathered(self.first, parts.take(pa.array(begins)), True)
        firsts = _slices(heads, np.cumsum(head_each))
        glued = self._glued_ids([run[k] for k in sorted(open_texts)])
        for k, (head, tail) in enumerate(zip(firsts, _slices(ids, bounds[1:]))):
            yield next(glued) if k in open_texts else head + tail

    def _glued_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Texts some of whose parts need gluing, all looked up at once."""
        if not texts:
            return
        cut = [self._glue(t.split(b" ")) for t in texts]
        heads, head_each = self._gathered(self.first, pa.array([c[0] for c in cut], pa.binary()), True)
        tails, each = self._gathered(self.later, pa.array([p for c in cut for p in c[1:]], pa.binary()), False)
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum([len(c) - 1 for c in cut])]
        for head, tail in zip(_slices(heads, np.cumsum(head_each)), _slices(tails, ends)):
            yield head + tail

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        for run in slices(texts):
            yield from self._words(run) if self.kind == "words" else self._spaced(run)


def _slices(ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    data = memoryview(ids.astype("<u4", copy=False).tobytes())
    start = 0
    for end in (4 * ends).tolist():
        yield bytes(data[start:end])
        start = end
