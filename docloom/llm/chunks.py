"""Texts cut where no token can cross, so that each distinct chunk is tokenized once.

A slice of texts is one byte array. A 256 x 256 table says between which bytes a cut is safe; chunks are
grouped by their bytes in numpy, and only the distinct ones of a slice reach Python, where a bounded cache of
bytes keeps what is known of each. The values are concatenated per text by one ragged gather.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import distinct_chunks, ragged

#: Distinct chunks a worker keeps; beyond half of it a new generation begins and the one before the last goes. Long
#: chunks are never kept.
CACHE = 700_000
LONGEST = 48


class ChunkCache:
    """Values of chunks; value(list of chunk bytes) gives a list of bytes-like values, one for each chunk.

    A process keeps the chunks of one cache, the last used: workers are used again by the next stage.
    """

    _last: ChunkCache | None = None

    def __init__(self, value: Callable[[list[bytes]], list[bytes]], most: int | None = None):
        self.value, self.most = value, most or CACHE
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def many(self, chunks: list[bytes]) -> list[bytes]:
        last = ChunkCache._last
        if last is not self:
            if last is not None:
                last.kept, last.older = {}, {}
            ChunkCache._last = self
        out = [self.kept.get(c) for c in chunks]
        missing = [i for i, v in enumerate(out) if v is None]
        if missing and self.older:  # what is still in use moves on
            for i in missing:
                v = out[i] = self.older.get(chunks[i])
                if v is not None:
                    self._keep(chunks[i], v)
            missing = [i for i in missing if out[i] is None]
        if missing:
            for i, v in zip(missing, self.value([chunks[i] for i in missing])):
                out[i] = v
                if len(chunks[i]) <= LONGEST:
                    self._keep(chunks[i], v)
        return out

    def _keep(self, chunk: bytes, value: bytes) -> None:
        if len(self.kept) >= self.most // 2:
            self.older, self.kept = self.kept, {}
        self.kept[chunk] = value


def cut(data: np.ndarray, offsets: np.ndarray, safe: np.ndarray, mapped: np.ndarray | None = None) -> np.ndarray:
    """Starts of chunks: starts of non-empty rows, and places where safe[previous byte, byte]."""
    m = data if mapped is None else mapped
    start = np.zeros(len(data), bool)
    if len(data) > 1:
        start[1:] = safe.ravel()[(m[:-1].astype(np.uint16) << 8) | m[1:]]
    rows = offsets[:-1]
    start[rows[rows < len(data)]] = True
    return np.flatnonzero(start)


def gather(data: np.ndarray, starts: np.ndarray, cache: ChunkCache, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of all chunks end to end as bytes, bytes of each chunk's value), for values of `unit` bytes each."""
    ends = np.append(starts[1:], len(data))
    first, which = distinct_chunks(data, starts, ends)
    raw = memoryview(data)
    values = cache.many([bytes(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())])
    size = np.fromiter(map(len, values), np.int64, len(values)) // unit
    pool = np.frombuffer(b"".join(values), np.uint8).reshape(-1, unit)
    at = np.cumsum(size) - size
    n = size[which]
    return pool[ragged(at[which], n)], n
