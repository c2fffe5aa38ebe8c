"""A cuckoo filter over 128-bit keys: four 16-bit slots a bucket, whole arrays of keys at a time."""

from __future__ import annotations

import numpy as np

SLOTS, LOAD, ROUNDS = 4, 0.85, 400


class CuckooFilter:
    """Answers "maybe present" or "surely absent" and supports deletion. Each key is to be inserted once and deleted
    at most once; an exact table beside the filter sees to that. ``high`` and ``low`` are the halves of the keys."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(6, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _print(self, low: np.ndarray) -> np.ndarray:
        return np.maximum((low & np.uint64(0xFFFF)).astype(np.uint16), np.uint16(1))

    def _first(self, high: np.ndarray) -> np.ndarray:
        return (high & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, a = self._print(low), self._first(high)
        b = self._other(a, mark)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of the given buckets; returns which didn't fit."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        rank = np.arange(len(b)) - np.repeat(head, np.diff(np.append(head, len(b))))
        free = self.table[b] == 0
        nth = np.cumsum(free, axis=1)
        fits = rank < nth[:, -1]
        slot = (nth > rank[:, None]).argmax(axis=1)
        self.table[b[fits], slot[fits]] = mark[order][fits]
        left = np.zeros(len(b), bool)
        left[order[~fits]] = True
        return left

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False if the table is too full: then build a larger one from the exact keys."""
        mark, bucket = self._print(low), self._first(high)
        rng = np.random.default_rng(7)
        for turn in range(ROUNDS):
            if not len(bucket):
                return True
            left = self._place(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if turn and len(bucket):  # one key of each full bucket takes the place of another, which moves on
                _, one = np.unique(bucket, return_index=True)
                slot = rng.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], slot]
                self.table[bucket[one], slot] = mark[one]
                mark[one] = out
            bucket = self._other(bucket, mark)
        return not len(bucket)

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        mark, a = self._print(low), self._first(high)
        for i, (x, y) in enumerate(zip(a.tolist(), self._other(a, mark).tolist(), strict=True)):
            for bucket in (x, y):
                at = np.flatnonzero(self.table[bucket] == mark[i])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def build(high: np.ndarray, low: np.ndarray) -> CuckooFilter:
    """A filter that holds all the (distinct) keys."""
    size = len(high)
    while True:
        made = CuckooFilter.of_size(size)
        if made.insert(high, low):
            return made
        size = 2 * size + 8
