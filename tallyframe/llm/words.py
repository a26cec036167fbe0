"""Words and lines of whole Arrow batches, cut by byte classes without a loop per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes: part of a word, a gap between words, a gap that also ends a piece.
WORD, GAP, BREAK = 0, 1, 2
#: Bytes of text per vectorised step; a longer text is a step of its own.
STEP_BYTES = 8_000_000


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


#: ``[\x20\x09-\x0D]`` between words.
WHITE_SPACE = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")

#: ``A-Z`` to ``a-z``, every other byte to itself.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A"):ord("Z") + 1] += 32


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, large_string slice) of consecutive texts, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + step_bytes, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the offset of each text in them."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``, ending at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def split_words(texts: pa.Array, classes: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as binary, text number of each, piece number of each) of a step. A new
    piece starts with each text and after each run of gaps that holds a ``BREAK``."""
    data, offsets = raw_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return binary_array(data, none), none, none
    kinds = classes[data]
    inside = kinds == WORD
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # where a text starts (the end of the last one as well)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    at = np.flatnonzero(starts)
    lengths = np.flatnonzero(ends) - at + 1
    text_no = np.searchsorted(offsets, at, "right") - 1
    breaks = np.cumsum(kinds == BREAK, dtype=np.int64)[at] + text_no  # grows with every break and text
    kept = data[inside]
    return binary_array(ASCII_LOWER[kept] if lower else kept, np.cumsum(lengths)), text_no, breaks


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines cut at line feeds, text number of each) of a step; an empty text is one empty line."""
    lines = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    return lines.flatten(), np.repeat(np.arange(len(texts)), counts)
