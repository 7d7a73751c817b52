"""Cuckoo filter over 128-bit keys given as two int64 columns, with vectorised lookups."""

from __future__ import annotations

import struct

import numpy as np

SLOTS, KICKS = 4, 500


class CuckooFilter:
    """Holds 16-bit fingerprints in buckets of four; supports insert, delete and contains.

    A key must be inserted once and deleted once: the exact table beside the filter says when.
    """

    def __init__(self, capacity: int = 64, cells: np.ndarray | None = None):
        n = 1
        while n * SLOTS * 0.84 < max(capacity, 1):
            n *= 2
        self.cells = np.zeros((n, SLOTS), np.uint16) if cells is None else cells

    def _places(self, h1, h2):
        h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
        mask = np.uint64(len(self.cells) - 1)
        f = (h2 & np.uint64(0xFFFF)).astype(np.uint16)
        f = np.where(f == 0, np.uint16(1), f)
        i = h1 & mask
        return f, i.astype(np.int64), (i ^ (self._step(f) & mask)).astype(np.int64)

    @staticmethod
    def _step(f):
        return (f.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)

    def contains(self, h1, h2) -> np.ndarray:
        f, i, j = self._places(h1, h2)
        return (self.cells[i] == f[:, None]).any(1) | (self.cells[j] == f[:, None]).any(1)

    def insert(self, h1, h2) -> bool:
        """Add the keys; False if the filter is too full (then build a larger one from the exact table)."""
        rng = np.random.default_rng(len(self.cells))
        mask = len(self.cells) - 1
        for f, i, j in zip(*self._places(h1, h2), strict=True):
            for b in (i, j):
                free = np.flatnonzero(self.cells[b] == 0)
                if len(free):
                    self.cells[b, free[0]] = f
                    break
            else:
                b = i
                for _ in range(KICKS):
                    k = int(rng.integers(SLOTS))
                    f, self.cells[b, k] = self.cells[b, k], f
                    b = int(b) ^ (int(self._step(np.asarray(f))) & mask)
                    free = np.flatnonzero(self.cells[b] == 0)
                    if len(free):
                        self.cells[b, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, h1, h2) -> None:
        for f, i, j in zip(*self._places(h1, h2), strict=True):
            for b in (i, j):
                at = np.flatnonzero(self.cells[b] == f)
                if len(at):
                    self.cells[b, at[0]] = 0
                    break

    def _fill(self, f, at) -> np.ndarray:
        """Put fingerprints into their buckets at once as far as there is room; those that found none."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        used = (self.cells[bucket] != 0).sum(1)  # buckets are filled from the front
        room = used + rank < SLOTS
        self.cells[bucket[room], (used + rank)[room]] = f[order][room]
        return order[~room]

    @classmethod
    def of(cls, h1, h2) -> CuckooFilter:
        """A filter over the keys, built in bulk: first buckets, then second ones, then one by one what found neither."""
        h1, h2 = np.asarray(h1, np.int64), np.asarray(h2, np.int64)
        size = max(len(h1), 8)
        while True:
            out = cls(size)
            f, i, j = out._places(h1, h2)
            left = out._fill(f, i)
            left = left[out._fill(f[left], j[left])]
            if out.insert(h1[left], h2[left]):
                return out
            size = int(size * 1.7)

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.cells)) + self.cells.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        (n,) = struct.unpack_from("<I", raw)
        return cls(cells=np.frombuffer(raw, "<u2", n * SLOTS, 4).reshape(n, SLOTS).copy())
