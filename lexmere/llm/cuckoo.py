"""A vectorised cuckoo filter: membership with deletion, no false negatives.

16-bit fingerprints in buckets of four; a key has two buckets, and either follows from
the other and the fingerprint. A full filter gets a second table after it, so growth
never needs the keys; buckets are widened for fingerprints that found no place by moving.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
ROUNDS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Keys are pairs of uint64 arrays (h1, h2); insert a key once, delete what was inserted."""

    def __init__(self, expected: int = 64):
        self.tables: list[np.ndarray] = []
        self._add_table(expected)

    def _add_table(self, expected: int) -> None:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(expected, 1) / (SLOTS * LOAD)))))
        self.tables.append(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def _prints(h2: np.ndarray) -> np.ndarray:
        return (h2 % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    @staticmethod
    def _places(table: np.ndarray, h1: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(table) - 1)
        first = h1 >> np.uint64(32) & mask  # the low bits are those that keys of one shard share
        return first.astype(np.int64), (first ^ (_spread(prints) & mask)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints = self._prints(h2)
        found = np.zeros(len(h1), bool)
        for table in self.tables:
            for place in self._places(table, h1, prints):
                found |= (table[place] == prints[:, None]).any(axis=1)
        return found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        if not len(h1):
            return
        table = self.tables[-1]
        room = int(table.size * LOAD) - int(np.count_nonzero(table))
        if room < len(h1):
            if room > 0:
                self.insert(h1[:room], h2[:room])
                h1, h2 = h1[room:], h2[room:]
            self._add_table(max(2 * int(table.size * LOAD), len(h1)))
            return self.insert(h1, h2)
        prints = self._prints(h2)
        place, other = self._places(table, h1, prints)
        draw = np.random.default_rng(len(h1))
        mask = np.uint64(len(table) - 1)
        for _ in range(ROUNDS):
            for _turn in range(2):
                left = self._settle(table, place, prints)
                place, other, prints = other[left], place[left], prints[left]
                if not len(prints):
                    return
            # one fingerprint per bucket is put out and moves to its other bucket
            _, first = np.unique(place, return_index=True)
            slot = draw.integers(0, table.shape[1], len(first))
            out = table[place[first], slot]
            table[place[first], slot] = prints[first]
            here = place[first]
            there = (here.astype(np.uint64) ^ (_spread(out) & mask)).astype(np.int64)
            rest = np.ones(len(prints), bool)
            rest[first] = False
            place = np.concatenate([there, place[rest]])
            other = np.concatenate([here, other[rest]])
            prints = np.concatenate([out, prints[rest]])
        grown = np.zeros((len(table), table.shape[1] * 2), np.uint16)
        grown[:, : table.shape[1]] = table
        left = self._settle(grown, place, prints)
        while left.any():
            wider = np.zeros((len(grown), grown.shape[1] * 2), np.uint16)
            wider[:, : grown.shape[1]] = grown
            grown, place, prints = wider, place[left], prints[left]
            left = self._settle(grown, place, prints)
        self.tables[-1] = grown

    @staticmethod
    def _settle(table: np.ndarray, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; True where there was none."""
        order = np.argsort(place, kind="stable")
        sorted_place = place[order]
        starts = np.r_[True, sorted_place[1:] != sorted_place[:-1]] if len(order) else np.zeros(0, bool)
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        rows = table[sorted_place]
        free = rows == 0
        rank = np.cumsum(free, axis=1)
        fits = run < rank[:, -1] if len(order) else np.zeros(0, bool)
        slot = np.argmax(free & (rank == run[:, None] + 1), axis=1)
        table[sorted_place[fits], slot[fits]] = prints[order[fits]]
        left = np.ones(len(place), bool)
        left[order[fits]] = False
        return left

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; every key must have been inserted."""
        prints = self._prints(h2)
        for i in range(len(h1)):
            for table in self.tables:
                done = False
                for place in self._places(table, h1[i : i + 1], prints[i : i + 1]):
                    hit = np.flatnonzero(table[place[0]] == prints[i])
                    if len(hit):
                        table[place[0], hit[0]] = 0
                        done = True
                        break
                if done:
                    break

    def to_bytes(self) -> bytes:
        head = [len(self.tables), *(x for t in self.tables for x in t.shape)]
        return np.array(head, "<u8").tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        out = cls.__new__(cls)
        out.tables = []
        n = int(np.frombuffer(data, "<u8", 1)[0])
        shapes = np.frombuffer(data, "<u8", 2 * n, 8).reshape(n, 2)
        at = 8 + 16 * n
        for rows, slots in shapes.tolist():
            table = np.frombuffer(data, np.uint16, rows * slots, at).reshape(rows, slots)
            out.tables.append(table.copy())
            at += 2 * rows * slots
        return out
