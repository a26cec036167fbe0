"""Exact ids of the ``tokenizers`` library for whole texts, one call per distinct chunk.

A byte-level BPE splits a text before merging, and a single space (or line feed)
between two characters that are not white space always starts a new piece. So the
ids of a text are the ids of its chunks, cut before each such separator. Texts
repeat most chunks: each Arrow batch is split and dictionary-encoded, the library
encodes the chunks that this worker has not met, and the ids of a text are a slice
of the gathered dictionary values. Texts in which a separator touches other white
space are encoded whole by the library.

Where the vocabulary's pattern cuts punctuation off the letter or digit before it,
the punctuation that ends a chunk is encoded apart from the chunk, so that a word is
one chunk whatever follows it.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyframe.llm.chunk_memo import ChunkMemo
from tallyframe.llm.common import worker_state
from tallyframe.llm.words import binary_array, raw_bytes

#: Chunks a worker remembers before it forgets those not met lately (memory only, never results).
MEMO_CHUNKS = 1_000_000
#: Bytes of text per vectorised step.
STEP_BYTES = 8_000_000
#: New chunks that go to the library as one text.
JOINED = 256
#: Different endings that a worker remembers before it starts afresh, and characters of one.
MEMO_TAILS = 10_000
TAIL_LENGTH = 64
PUNCTUATION = frozenset(string.punctuation.encode())
ALPHANUMERIC = np.isin(np.arange(256), list((string.ascii_letters + string.digits).encode()))


class ChunkEncoder:
    """``encode(texts)`` gives one ``bytes`` of little-endian uint32 ids per text."""

    def __init__(self, library_batch, starts: np.ndarray | None = None, spaced: bool = False,
                 memo_chunks: int = MEMO_CHUNKS, tails: frozenset[int] = frozenset(), word_batch=None):
        #: list of texts -> list of uint32 id lists (the encoder proper)
        self.library_batch = library_batch
        #: by id: does its string start with a space or a line feed?
        self.starts = starts
        #: encode a space and the text instead of the text
        self.spaced = spaced
        self.memo = ChunkMemo(memo_chunks)
        #: by byte: may it be part of a chunk's ending, which is a piece of its own after a letter or digit?
        self.tails = np.isin(np.arange(256), list(tails)) if tails else None
        self.tail_memo: dict[str, bytes] = {}
        #: lists of words of ASCII letters -> as ``library_batch`` for each list's words, a space before each
        self.word_batch = word_batch
        self.newline = b"" if spaced else self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.library_batch(texts)]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with safe edges, each with its separator: its own line feed, or a
        space before it. Joined, they are still encoded one by one, and only a chunk's
        first id starts with its separator, so the ids split again."""
        if self.starts is None:
            return self._ids([c if c[0] == "\n" else " " + c for c in chunks])
        if self.word_batch is None:
            return self._split_ids(chunks, self._joined_batch)
        plain = [c.isascii() and c.isalpha() for c in chunks]
        words = iter(self._split_ids([c for c, is_word in zip(chunks, plain) if is_word], self.word_batch))
        others = iter(self._split_ids([c for c, is_word in zip(chunks, plain) if not is_word], self._joined_batch))
        return [next(words if is_word else others) for is_word in plain]

    def _joined_batch(self, groups: list[list[str]]) -> list[list[int]]:
        # a chunk holds no space, and a line feed only as its first character
        return self.library_batch([(" " + " ".join(g)).replace(" \n", "\n") for g in groups])

    def _split_ids(self, chunks: list[str], batch) -> list[bytes]:
        """Ids of each chunk, from ``batch`` over groups of them."""
        out: list[bytes] = []
        groups = [chunks[at:at + JOINED] for at in range(0, len(chunks), JOINED)]
        for group, ids in zip(groups, batch(groups)):
            ids = np.fromiter(ids, "<u4", len(ids))
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(group) or cuts[0] != 0:
                raise ValueError("the vocabulary joins chunks")
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        return out

    def _lookup(self, pieces: pa.Array) -> pa.Array:
        """Ids of each of the (different) pieces; none where white space touches its separators."""
        found = self.memo.find(pieces)
        missed = np.flatnonzero(found < 0)
        known = self.memo.ids_of(found[found >= 0])
        if not len(missed):
            return known
        new = pieces.take(pa.array(missed))
        texts = new.to_numpy(zero_copy_only=False).tolist()
        bodies = [p[1:] if p[:1] == "\n" else p for p in texts]
        safe = [bool(body) and body.strip() == body for body in bodies]
        ids = iter(self._chunk_ids([p for p, is_safe in zip(texts, safe) if is_safe]))
        fresh = pa.array([next(ids) if is_safe else b"" for is_safe in safe], pa.large_binary())
        self.memo.add(new, fresh)
        place = np.empty(len(found), np.int64)
        place[found >= 0] = np.arange(len(known))
        place[missed] = len(known) + np.arange(len(missed))
        return pa.concat_arrays([known, fresh]).take(pa.array(place))

    def _tail_ids(self, tails: list[str]) -> list[bytes]:
        """Ids of endings, each alone a piece of the pattern."""
        memo = self.tail_memo
        new = [t for t in tails if t and t not in memo]
        fresh = {"": b"", **dict(zip(new, self._ids(new)))}
        out = [fresh[t] if t in fresh else memo[t] for t in tails]
        if len(memo) + len(fresh) > MEMO_TAILS:
            memo.clear()
        memo.update((t, ids) for t, ids in fresh.items() if len(t) <= TAIL_LENGTH)
        return out

    def _ids_by_piece(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids of each piece, whether white space touches its separators)."""
        if self.tails is None:
            ids = self._lookup(pieces)
            return ids, pc.equal(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False)
        data, offsets = raw_bytes(pieces)
        starts, ends = offsets[:-1], offsets[1:]
        # of each piece: the place behind the last byte that is not of an ending
        inner = np.append(0, np.maximum.accumulate(np.where(self.tails[data], 0, np.arange(1, len(data) + 1))))[ends]
        cut = np.where((inner > starts) & ALPHANUMERIC[np.append(data, 0)[inner - 1]], inner, ends)
        marks = np.zeros(len(data) + 1, np.int8)
        marks[cut[cut < ends]] = 1
        marks[ends[cut < ends]] -= 1
        tail = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
        stems = binary_array(data[~tail], np.cumsum(cut - starts)).cast(pa.large_string()).dictionary_encode()
        tails = binary_array(data[tail], np.cumsum(ends - cut)).cast(pa.large_string()).dictionary_encode()
        ids = self._lookup(stems.dictionary).take(stems.indices)
        tail_ids = pa.array(self._tail_ids(tails.dictionary.to_pylist()), pa.large_binary()).take(tails.indices)
        return (pc.binary_join_element_wise(ids, tail_ids, pa.scalar(b"", pa.large_binary())),
                pc.equal(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False))

    def _step(self, texts: pa.Array) -> list[bytes]:
        # every piece that follows a line feed, the first one included, starts with it
        # (a spaced text needs no mark: its first piece follows a space like the others)
        mark, glue = pa.scalar("" if self.spaced else "\n", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n"), glue)
        split = pc.split_pattern(marked, " ")
        offsets, pieces = split.offsets.to_numpy(), split.values.dictionary_encode()
        del marked, split
        ids, unsafe = self._ids_by_piece(pieces.dictionary)
        gathered = ids.take(pieces.indices)
        data = memoryview(gathered.buffers()[2] or b"")
        ends = np.frombuffer(gathered.buffers()[1], "<i8", len(gathered) + 1)[offsets]
        bad = np.zeros(len(texts), bool)
        if unsafe.any():
            bad = np.logical_or.reduceat(unsafe[pieces.indices.to_numpy()], offsets[:-1])
        skip = len(self.newline)  # the marker before the first piece is not part of the text
        out = [data[a + skip:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        whole = np.flatnonzero(bad).tolist()
        if whole:
            lead = " " if self.spaced else ""
            for k, ids_k in zip(whole, self._ids([lead + texts[k].as_py() for k in whole])):
                out[k] = ids_k
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out: list[bytes] = []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + STEP_BYTES, "right")))
            out += self._step(pa.concat_arrays([texts.slice(start, stop - start)]))
            start = stop
        return out


def endings(tok) -> frozenset[int]:
    """ASCII punctuation that ``tok`` cuts off the letter or digit before it and that is
    no part of an added token; none unless ``tok`` is byte-level with its usual pattern,
    and all its added tokens hold punctuation."""
    from tokenizers.pre_tokenizers import ByteLevel
    if tok.normalizer is not None or not isinstance(tok.pre_tokenizer, ByteLevel) or not tok.pre_tokenizer.use_regex:
        return frozenset()
    added = [set(t.content.encode()) for t in tok.get_added_tokens_decoder().values()]
    return PUNCTUATION.difference(*added) if all(PUNCTUATION & a for a in added) else frozenset()


def library_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for the ``tokenizers`` file at ``path``."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        # byte-level vocabularies write a space as U+0120 and a line feed as U+010A
        starts = np.zeros(max(tok.get_vocab().values()) + 1, bool)
        starts[[i for s, i in tok.get_vocab().items() if s[0] in "\u0120\u010a"]] = True
        tails, word_batch = endings(tok), None
        if tails:
            # a space and ASCII letters are one piece of the pattern, written U+0120 and the letters
            words = Tokenizer(tok.model)
            words.pre_tokenizer = CharDelimiterSplit("\n")

            def word_batch(groups: list[list[str]]) -> list[list[int]]:
                joined = ["\u0120" + "\n\u0120".join(g) for g in groups]
                return [e.ids for e in words.encode_batch_fast(joined, add_special_tokens=False)]
        return ChunkEncoder(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], starts,
                            tails=tails, word_batch=word_batch)
    return worker_state(("library", path), make)
