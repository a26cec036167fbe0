"""Counting quotient filters of packed word-id n-grams: lossless, sorted, mergeable.

An n-gram of ``k`` word ids of ``b`` bits is packed into ``k * b`` bits, held as a few
columns of at most 64 bits. A Feistel network over the columns permutes these bits:
it is invertible, so nothing is lost, and its output is uniform, so quotient ranges
are equal shards whatever the n-grams. Of a permuted value the high bits are the
quotient, all others the remainder. A filter of one shard stores, in order of the
values, a bit per quotient (occupied or not), a bit per entry (last of its quotient
or not), the full remainders, and counts of one byte with an exception list. Filters
of one shard merge as sorted lists whose equal entries add up.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = 3  # times the number of columns
SPREAD = np.uint64(0x9E3779B97F4A7C15)
HEADER = "<QQB"  # entries, large counts, bits of the quotient


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shape:
    """How ``k`` ids of ``b`` bits lie in columns: ``widths`` in bits, high column first."""

    def __init__(self, k: int, b: int):
        if not 1 <= b <= 32 or k < 2:
            raise ValueError("two ids or more of at most 32 bits")
        self.k, self.b = k, b
        per = min(64 // b, -(-k // 2))  # two columns at least, so that the network has halves
        self.sizes = [min(per, k - at) for at in range(0, k, per)]
        self.widths = [n * b for n in self.sizes]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Columns of the n-grams whose j-th ids are ``ids[j]``."""
        out, at = [], 0
        for n in self.sizes:
            column = np.zeros(len(ids[0]), np.uint64)
            for x in ids[at:at + n]:
                column = (column << np.uint64(self.b)) | x.astype(np.uint64)
            out.append(column)
            at += n
        return out

    def unpack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        low, out = np.uint64((1 << self.b) - 1), []
        for n, column in zip(self.sizes, columns):
            out += [(column >> np.uint64(self.b * (n - 1 - j))) & low for j in range(n)]
        return out

    def _round(self, columns: list[np.ndarray], number: int) -> None:
        m = len(columns)
        target = number % m
        key = np.full(len(columns[0]), number + 1, np.uint64) * SPREAD
        for j in range(m):
            if j != target:
                key = mixed(key ^ columns[j])
        columns[target] = columns[target] ^ (key >> np.uint64(64 - self.widths[target]))

    def permute(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        columns = list(columns)
        for number in range(ROUNDS * len(columns)):
            self._round(columns, number)
        return columns

    def restore(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        columns = list(columns)
        for number in reversed(range(ROUNDS * len(columns))):
            self._round(columns, number)
        return columns


class Entries:
    """Sorted distinct values (columns) and their counts."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        self.columns, self.counts = columns, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, columns: list[np.ndarray], counts: np.ndarray | None = None) -> Entries:
        """Sort, and add up what is equal."""
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        if counts is None:
            summed = np.diff(np.append(first, len(order)))
        else:
            summed = np.add.reduceat(counts[order], first) if len(first) else counts
        return cls([c[first] for c in columns], summed.astype(np.int64))

    @classmethod
    def merged(cls, parts: list[Entries]) -> Entries:
        if len(parts) == 1:
            return parts[0]
        return cls.of([np.concatenate(c) for c in zip(*(p.columns for p in parts))],
                      np.concatenate([p.counts for p in parts]))

    def shards(self, shape: Shape, bits: int):
        """(shard, its entries): the shard is the highest ``bits`` of a value."""
        shard = (self.columns[0] >> np.uint64(shape.widths[0] - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
            yield int(shard[a]), Entries([c[a:b] for c in self.columns], self.counts[a:b])


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value in whole bytes."""
    n = -(-width // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _widen(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    size = -(-width // 8)
    if size:
        out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(n, size)
    return out.view("<u8").reshape(n)


def encode(entries: Entries, shape: Shape, bits: int) -> bytes:
    """The filter of one shard of ``bits`` bits."""
    n, left = len(entries), shape.widths[0] - bits
    q = min(left, max(0, (n - 1).bit_length()))
    inner = entries.columns[0] & np.uint64((1 << left) - 1)
    quotient = inner >> np.uint64(left - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    last = np.append(quotient[1:] != quotient[:-1], True)
    parts = [np.packbits(occupied).tobytes(), np.packbits(last).tobytes(),
             _narrow(inner & np.uint64((1 << (left - q)) - 1), left - q)]
    parts += [_narrow(c, w) for c, w in zip(entries.columns[1:], shape.widths[1:])]
    large = np.flatnonzero(entries.counts >= 255)
    parts += [np.minimum(entries.counts, 255).astype(np.uint8).tobytes(), entries.counts[large].astype("<i8").tobytes()]
    return struct.pack(HEADER, n, len(large), q) + b"".join(parts)


def decode(raw: bytes, shape: Shape, bits: int, shard: int) -> Entries:
    n, n_large, q = struct.unpack_from(HEADER, raw)
    left, view, at = shape.widths[0] - bits, memoryview(raw), struct.calcsize(HEADER)

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size:at]

    occupied = np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q)
    last = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n)
    run = np.cumsum(last) - last  # the number of the run that an entry belongs to
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    first = _widen(take(n * -(-(left - q) // 8)), n, left - q)
    first = first | (quotient << np.uint64(left - q)) | np.uint64(shard << left)
    columns = [first] + [_widen(take(n * -(-w // 8)), n, w) for w in shape.widths[1:]]
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large), "<i8")
    return Entries(columns, counts)
