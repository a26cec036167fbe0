"""What a worker remembers of the chunks it has encoded: short texts to ids, a batch at a time.

A chunk of up to ``WIDTH - 1`` bytes and its length are one key of ``WIDTH`` bytes, so
different chunks have different keys; longer ones are not remembered. Keys lie in an
array with open addressing, so that a whole Arrow batch is looked up in a few numpy
steps, without an object per chunk. When it is full, the half met longest ago is
forgotten (memory only, never results).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyframe.llm.words import raw_bytes

#: Bytes of a key: of the chunk (zeros behind it), and one for its length.
WIDTH = 32
#: By length: ones where a key holds bytes of the chunk.
MASK = np.where(np.arange(WIDTH) < np.arange(WIDTH)[:, None], 255, 0).astype(np.uint8)
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the texts that fit a key, their keys as rows of 64-bit words)."""
    data, offsets = raw_bytes(texts)
    sizes = np.diff(offsets)
    fit = np.flatnonzero(sizes < WIDTH)
    padded = np.append(data, np.zeros(WIDTH, np.uint8))
    keys = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[offsets[:-1][fit]] & MASK[sizes[fit]]
    keys[:, -1] = sizes[fit]
    return fit, keys.view(np.uint64)


class ChunkMemo:
    """Ids of up to ``capacity`` chunks."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits = max(4, (2 * capacity - 1).bit_length())
        self.batch = 0
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        #: by slot: number of the chunk, or -1
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((self.capacity, WIDTH // 8), np.uint64)
        #: the batch in which a chunk was last met
        self.met = np.empty(self.capacity, np.int32)
        #: the ids of the chunks one after the other, and where those of each end
        self.ends = np.zeros(self.capacity + 1, np.int64)
        self.ids = np.empty(0, np.uint8)

    def __contains__(self, chunk: str) -> bool:
        return bool(self.find(pa.array([chunk], pa.large_string()))[0] >= 0)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for k in range(keys.shape[1]):
            h = (h ^ keys[:, k]) * MIX[k]
            h ^= h >> np.uint64(29)
        return ((h * MIX[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, texts: pa.Array) -> np.ndarray:
        """Number of each text's chunk, or -1."""
        fit, keys = _keys(texts)
        found, slots, left = np.full(len(texts), -1, np.int64), self._slots(keys), np.arange(len(fit))
        while len(left):
            number = self.table[slots[left]]
            there = number >= 0
            left, number = left[there], number[there]
            same = (self.keys[number] == keys[left]).all(axis=1)
            found[fit[left[same]]] = number[same]
            left = left[~same]
            slots[left] = (slots[left] + 1) & (len(self.table) - 1)
        self.batch += 1
        self.met[found[found >= 0]] = self.batch
        return found

    def ids_of(self, numbers: np.ndarray) -> pa.Array:
        """Ids of the chunks with these numbers (those of the last ``find``)."""
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)])
        return values.take(pa.array(numbers))

    def add(self, texts: pa.Array, ids: pa.Array) -> None:
        """Remember different texts that were not found, and their ids (large_binary)."""
        fit, keys = _keys(texts)
        fit, keys = fit[:self.capacity], keys[:self.capacity]
        ids = ids.take(pa.array(fit))
        if self.size + len(fit) > self.capacity:
            self._forget()
        if self.size + len(fit) > self.capacity:
            self._clear()
        self._append(keys, ids, np.full(len(fit), self.batch, np.int32))

    def _forget(self) -> None:
        met = self.met[:self.size]
        kept = np.flatnonzero(met > np.partition(met, self.size // 2)[self.size // 2])
        keys, ids, met = self.keys[kept], self.ids_of(kept), met[kept]
        self._clear()
        self._append(keys, ids, met)

    def _append(self, keys: np.ndarray, ids: pa.Array, met: np.ndarray) -> None:
        data, offsets = raw_bytes(ids)
        first, last = self.size, self.size + len(keys)
        self.keys[first:last], self.met[first:last] = keys, met
        start = int(self.ends[first])
        self.ends[first + 1:last + 1] = start + offsets[1:]
        if start + len(data) > len(self.ids):
            self.ids = np.append(self.ids[:start], np.empty(len(data) + start // 4, np.uint8))
        self.ids[start:start + len(data)] = data
        self.size = last
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            own = slots[left]
            free = self.table[own] < 0
            self.table[own[free]] = first + left[free]  # of several for one slot, one stays
            left = left[self.table[own] != first + left]
            slots[left] = (slots[left] + 1) & (len(self.table) - 1)
