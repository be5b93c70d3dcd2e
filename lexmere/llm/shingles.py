"""Word shingles of whole texts as 64-bit hashes, computed over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
SEGMENT = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, SEGMENT + 1)
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_BASE, _BACK))
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word, A-Z lower-cased; a word is a run without ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers, back = _tables(len(raw))
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, white, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[_LOWER[raw]] * powers[: len(raw)])]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def _segments(data: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space where there is some."""
    at = 0
    while len(data) - at > SEGMENT:
        space = max(data.rfind(c, at, at + SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if space <= at:
            found = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, at)) >= 0]
            space = min(found, default=len(data))
        yield data[at:space]
        at = space
    yield data[at:]


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all windows of WIDTH words, in order."""
    out = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        out = out * _BASE + words[k : k + len(out)]
    return mix(out)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    if len(words) < WIDTH:
        one = np.uint64(len(words))
        for word in words:
            one = one * _BASE + word
        return mix(np.array([one]) ^ np.uint64(0x5851F42D4C957F2D))
    return np.unique(_grams(words))


def shingle_sets(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The shingle set of every text; many short texts are hashed together."""
    with np.errstate(over="ignore"):
        run: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > SEGMENT:
                yield from _run(run)
                run, size = [], 0
                yield shingle_set(np.concatenate([word_hashes(s)[0] for s in _segments(text)]))
                continue
            run.append(text)
            size += len(text) + 1
            if size > SEGMENT:
                yield from _run(run)
                run, size = [], 0
        yield from _run(run)


def _run(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, ends)
    at = 0
    for cut in cuts.tolist():
        yield shingle_set(hashes[at:cut])
        at = cut
