"""Byte-level BPE encoding and decoding, from the vocabulary file alone.

Encoding a piece: its symbols form a doubly linked list; a priority queue holds the
merge rank of each adjacent pair; the lowest rank (leftmost on ties) is merged, its
two new neighbour pairs are pushed, and entries whose symbols changed since are
skipped as stale. Decoding concatenates the vocabulary strings of the ids.

Defined cases: null text is empty (no ids); strings of special tokens in a text
become the special id, as the library does by default; ids without a vocabulary
string raise an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.chunk_encoder import ChunkEncoder
from tallyframe.llm.common import worker_state

#: Pieces a worker remembers before it starts afresh (memory only, never results).
MEMO_PIECES = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters for themselves, the others from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one byte-level BPE file of the ``tokenizers`` format."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: b for b, s in enumerate(symbols)}
        self.strings: list[bytes | None] = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) +
                                        ")") if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.string_array = pa.array(self.strings, pa.large_binary())
        self.decimal_array = pa.array([b"%d," % i for i in range(len(self.strings))], pa.large_binary())

    def merge(self, ids: list[int]) -> list[int]:
        """Merge one piece's symbols to the end."""
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has changed or gone
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((merged, ids[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, merged, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], merged))
                if m:
                    heapq.heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str, out: list[int]) -> None:
        memo = self.memo
        for piece in self.pieces(text):
            got = memo.get(piece)
            if got is None:
                got = self.merge([self.byte_ids[b] for b in piece.encode()])
                if len(piece) <= 64:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = got
            out += got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.split_special is None:
            self._plain(text, out)
            return out
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; ill-formed sequences become U+FFFD."""
        return joined(self.string_array, ids).decode("utf-8", "replace").encode()


def joined(strings: pa.Array, ids: np.ndarray) -> bytes:
    """The strings of ``ids`` one after the other."""
    if not len(ids):
        return b""
    taken = strings.take(pa.array(ids))
    if taken.null_count:
        raise ValueError("an id has no vocabulary string")
    return taken.buffers()[2].to_pybytes()


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), decoded text."""
    return _mapped(docs, tokenizer, _whole, "doc_id long, ids array<int>, decoded string",
                   [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded text."""
    return _mapped(docs, tokenizer, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _whole(bpe: Bpe, ids: np.ndarray) -> tuple:
    return ids.tolist(), bpe.decode(ids).decode()


def _digest(bpe: Bpe, ids: np.ndarray) -> tuple:
    decimal = joined(bpe.decimal_array, ids)[:-1]
    return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def _encoder(tokenizer: str) -> tuple[Bpe, ChunkEncoder]:
    bpe = Bpe(tokenizer)
    return bpe, ChunkEncoder(lambda texts: [bpe.encode(t) for t in texts])


def _mapped(docs: DataFrame, tokenizer: str, of, schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = worker_state(("bpe", tokenizer), lambda: _encoder(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [of(bpe, np.frombuffer(raw, "<u4")) for raw in encoder.encode(part.column(1))]
                columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, schema)
