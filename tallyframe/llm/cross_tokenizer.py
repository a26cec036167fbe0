"""Alignment of two tokenizers' ids over the same texts, by whitespace-token anchors.

Each text is tokenised whole by both. An anchor is a byte offset at which a token of
either ends and before which the next token of either is marked by a space; that both
end there is verified on the summed token lengths, and that the tokens spell the text
on their joined bytes. Anchors cut a document into windows, a tuple of A ids and a
tuple of B ids. Texts repeat most windows, so each different tuple is aligned once per
worker and batch (``Windows.memo``): offsets where a token of both ends cut it into
groups, and the last tokens of a group are linked. Documents are put together from
their windows.

Links are then counted per id pair over the corpus, and each document's links are
looked up in the counts, of which ``PAIRS_AT_ONCE`` are broadcast at a time (more
pairs take several passes over the links, with the same result).

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library (special tokens'
strings are plain text), B a ``sentencepiece`` model with byte fallback that puts a
space before the text; so A encodes a space and the text.

Defined cases: a text that is null, empty, or that either tokenizer does not spell
byte for byte has no tokens: zeros, an empty group digest, no links. Every row of the
documents is a row of the result, repeated rows and null ids included; an empty table
gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.bpe import byte_symbols
from tallyframe.llm.chunk_encoder import ChunkEncoder
from tallyframe.llm.common import staged, worker_state
from tallyframe.llm.words import raw_bytes, steps

#: Id pairs whose counts are broadcast at once (17 bytes each).
PAIRS_AT_ONCE = 4_000_000
#: Different windows a worker remembers before it starts afresh (memory only, never results).
MEMO_WINDOWS = 300_000
#: Different chunks that each of the two encoders remembers.
MEMO_CHUNKS = 150_000
#: Bytes of text that a task has in hand at once (a longer text alone).
STEP_BYTES = 2_000_000
SPACE_MARK = "▁"


class Vocabulary:
    """Byte string of each id, its length, and whether it starts with a space."""

    def __init__(self, strings: list[bytes]):
        self.strings = pa.array(strings, pa.large_binary())
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.spaced = np.array([s[:1] == b" " for s in strings], bool)
        self.decimal = pa.array([str(i) for i in range(len(strings))], pa.large_string())

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` one after the other."""
        data = self.strings.take(pa.array(ids)).buffers()[2] if len(ids) else None
        return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def library_a(path: str) -> tuple[ChunkEncoder, Vocabulary]:
    """Encoder of (a space and the text) and vocabulary of a byte-level ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    back = {s: b for b, s in enumerate(byte_symbols())}
    vocab = tok.get_vocab()
    strings = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        strings[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
    starts = np.array([s[:1] in (b" ", b"\n") for s in strings])
    encoder = ChunkEncoder(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)],
                           starts, True, MEMO_CHUNKS)
    return encoder, Vocabulary(strings)


def library_b(path: str) -> tuple[ChunkEncoder, Vocabulary]:
    """Encoder of texts (the model adds the space) and vocabulary of a ``sentencepiece`` file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    strings = []
    for i, name in enumerate(names):
        byte = re.fullmatch("<0x([0-9A-F]{2})>", name) if model.is_byte(i) else None
        strings.append(bytes([int(byte[1], 16)]) if byte else name.replace(SPACE_MARK, " ").encode())
    # a text may be encoded in chunks only if no piece joins a space or line feed to what stands before it
    apart = not any(SPACE_MARK in n.lstrip(SPACE_MARK) or "\n" in n for n in names)
    alone = model.piece_to_id(SPACE_MARK)

    def ids(texts: list[str]) -> list[list[int]]:
        # the model adds the space that a chunk or text starts with; before a line feed it is taken off
        out = model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if t[0] != " ":
                if out[k][0] != alone:
                    raise ValueError("the vocabulary joins chunks")
                out[k] = out[k][1:]
        return out

    encoder = ChunkEncoder(ids, None, True, MEMO_CHUNKS)
    if not apart:
        encoder.encode = lambda texts: [np.array(x, "<u4").tobytes() for x in model.encode(
            [t or "" for t in texts.to_pylist()], num_threads=1)]
    return encoder, Vocabulary(strings)


class Windows:
    """Aligns windows of ids, each different one once."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.a = library_a(path_a)
        self.encode_b, self.b = library_b(path_b)
        #: window key -> (its groups as text, each with ``;`` behind it; link pairs)
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}

    @property
    def base(self) -> int:
        """A pair's number is its A id times this, plus its B id."""
        return len(self.b.lengths)

    def _shared_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens that end at the same byte. Both spell the same bytes."""
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        return np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)[1:]

    def _aligned(self, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Windows by key, all at once: lists of groups are joined as Arrow arrays."""
        ids = np.frombuffer(b"".join(keys), "<u4")
        sizes = np.array([len(k) // 4 for k in keys])
        heads = np.cumsum(sizes) - sizes
        n_a = ids[heads].astype(np.int64)
        place = np.arange(len(ids)) - np.repeat(heads, sizes)
        is_a = (place > 0) & (place <= np.repeat(n_a, sizes))
        a, b = ids[is_a], ids[(place > 0) & ~is_a]
        at_a, at_b = self._shared_ends(a, b)
        # groups of each window: those whose last A token lies in it
        limits = np.searchsorted(at_a, np.append(0, np.cumsum(n_a)))

        def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)

        comma, bar, end, none = (pa.scalar(x, pa.large_string()) for x in (",", "|", ";", ""))
        groups = pc.binary_join_element_wise(pc.binary_join(lists(at_a + 1, self.a.decimal.take(pa.array(a))), comma),
                                             pc.binary_join(lists(at_b + 1, self.b.decimal.take(pa.array(b))), comma), bar)
        text = pc.binary_join_element_wise(pc.binary_join(lists(limits[1:], groups), end), none, end)
        pairs = (a[at_a].astype("<u8") * np.uint64(self.base) + b[at_b]).tobytes()
        return [(t, pairs[8 * i:8 * j]) for t, i, j in zip(text.cast(pa.large_binary()).to_pylist(), limits.tolist(),
                                                           limits[1:].tolist())]

    def _anchors(self, a: np.ndarray, b: np.ndarray, limits_a: np.ndarray, limits_b: np.ndarray):
        """Window ends, as counts of A and of B ids, over the ids of many texts that spell
        the same bytes: anchors, and the ends of the texts."""
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        mark_a, mark_b = np.append(self.a.spaced[a], True)[1:], np.append(self.b.spaced[b], True)[1:]
        mark_a[limits_a[1:][np.diff(limits_a) > 0] - 1] = True
        mark_b[limits_b[1:][np.diff(limits_b) > 0] - 1] = True
        at_a, at_b = np.flatnonzero(mark_a), np.flatnonzero(mark_b)
        _, i, j = np.intersect1d(ends_a[at_a], ends_b[at_b], assume_unique=True, return_indices=True)
        return at_a[i] + 1, at_b[j] + 1

    def documents(self, texts: pa.Array):
        """Of each text of one step: (A ids, B ids, groups, groups as text, link pairs as bytes)."""
        raw_a, raw_b = self.encode_a.encode(texts), self.encode_b.encode(texts)
        data, offsets = raw_bytes(texts)
        n = len(raw_a)
        sizes = np.diff(offsets)
        # a space stands before each text; a text that is not spelled, or is empty, has no ids
        whole = [s > 0 for s in sizes.tolist()]
        for k in range(n):
            if whole[k]:
                a, b = np.frombuffer(raw_a[k], "<u4"), np.frombuffer(raw_b[k], "<u4")
                text = data[offsets[k]:offsets[k + 1]]
                for v, ids in ((self.a, a), (self.b, b)):
                    got = v.spelled(ids)
                    whole[k] = whole[k] and len(got) == len(text) + 1 and got[0] == 32 and bool((got[1:] == text).all())
            if not whole[k]:
                raw_a[k] = raw_b[k] = b""
        a, b = np.frombuffer(b"".join(raw_a), "<u4"), np.frombuffer(b"".join(raw_b), "<u4")
        limits_a = np.cumsum([0, *(len(r) // 4 for r in raw_a)])
        limits_b = np.cumsum([0, *(len(r) // 4 for r in raw_b)])
        if not len(a):
            return [(0, 0, 0, b"", b"")] * n
        cut_a, cut_b = self._anchors(a, b, limits_a, limits_b)

        # window keys, one after the other: number of A ids, A ids, B ids
        n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        ends = np.cumsum(n_a + n_b + 1)
        heads = ends - (n_a + n_b + 1)
        keys = np.empty(int(ends[-1]), "<u4")
        keys[heads] = n_a
        window = np.repeat(np.arange(len(n_a)), n_a)
        keys[np.arange(len(a)) + window + 1 + (cut_b - n_b)[window]] = a
        window = np.repeat(np.arange(len(n_b)), n_b)
        keys[np.arange(len(b)) + window + 1 + cut_a[window]] = b
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)),
                                           pa.py_buffer(keys)]).dictionary_encode()
        memo, known = self.memo, coded.dictionary.to_pylist()
        if len(memo) > MEMO_WINDOWS:
            memo.clear()
        new = [key for key in known if key not in memo]
        if new:
            memo.update(zip(new, self._aligned(new)))
        found = [memo[key] for key in known]
        for key in new:
            if len(key) > 256:  # long windows hardly come again
                del memo[key]

        def gathered(which: int) -> tuple[memoryview, np.ndarray]:
            """The windows' values one after the other, and where each document's start."""
            taken = pa.array([f[which] for f in found], pa.large_binary()).take(coded.indices)
            at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
            return memoryview(taken.buffers()[2]), at[np.searchsorted(cut_a, limits_a, "right")]

        text, text_at = gathered(0)
        pairs, pairs_at = gathered(1)
        return [(int(limits_a[k + 1] - limits_a[k]), int(limits_b[k + 1] - limits_b[k]),
                 int(pairs_at[k + 1] - pairs_at[k]) // 8, text[text_at[k]:text_at[k + 1]], pairs[pairs_at[k]:pairs_at[k + 1]])
                for k in range(n)]


def _mapped(docs: DataFrame, path_a: str, path_b: str, schema: str, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = worker_state(("windows", path_a, path_b), lambda: Windows(path_a, path_b))
        for batch in batches:
            for start, texts in steps(batch.column(1), STEP_BYTES):
                own = columns(windows, windows.documents(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(texts)), **own})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, schema)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``): the alignment itself."""
    def columns(_, found):
        return {"n_a": pa.array([f[0] for f in found], pa.int64()), "n_b": pa.array([f[1] for f in found], pa.int64()),
                "groups": pa.array([bytes(f[3][:-1]).decode() for f in found], pa.string())}
    return _mapped(docs, path_a, path_b, "doc_id long, n_a long, n_b long, groups string", columns)


def _linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: counts, group digest, and its links as sorted pair numbers."""
    def columns(_, found):
        sha = [hashlib.sha256(f[3][:-1]).hexdigest() if len(f[3]) else "" for f in found]
        links = [np.sort(np.frombuffer(f[4], "<u8")).tobytes() for f in found]
        counts = {name: pa.array([f[k] for f in found], pa.int64()) for name, k in (("n_a", 0), ("n_b", 1), ("n_groups", 2))}
        return {**counts, "groups_sha256": pa.array(sha, pa.string()), "links": pa.array(links, pa.binary())}
    return _mapped(docs, path_a, path_b,
                   "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary", columns)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold each id pair."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).cast(pa.large_binary())
            _, offsets, data = raw.buffers()
            at = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
            if data is not None and at[-1] > at[0]:
                links = np.frombuffer(data, "<u8", int(at[-1] - at[0]) // 8, int(at[0]))
                pairs, n = np.unique(links, return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return linked.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, path_a: str, path_b: str, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    spark = docs.sparkSession
    base = vocabulary_size(path_b)
    linked = staged(_linked(docs, path_a, path_b), "token-links")
    counted = staged(pair_counts(linked).withColumn("b", F.col("pair") % base), "token-pairs")
    # as many rows as B has ids, so AQE may broadcast it; a common B id costs one row per task
    most = counted.groupBy("b").agg(F.max("n").alias("most")).withColumnRenamed("b", "_b")
    judged = staged(counted.join(most, F.col("b") == F.col("_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
                    "token-pairs")
    parts = max(1, -(-judged.count() // pairs_at_once))
    out = linked.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for part in range(parts):
        own = judged.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).sort("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(own.column(c).to_numpy() for c in ("pair", "n", "best")))

        def look(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            pairs, n, best = table.value
            for batch in batches:
                best_of, sum_of = (batch.column(k).to_numpy().copy() for k in (6, 7))
                for k, raw in enumerate(batch.column(5)):
                    links = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
                    if len(links) and len(pairs):
                        at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                        at = at[pairs[at] == links]
                        best_of[k] += int(best[at].sum())
                        sum_of[k] += int(n[at].sum())
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(best_of), pa.array(sum_of)], batch.schema.names)

        out = out.mapInArrow(look, out.schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                      "groups_sha256")


def vocabulary_size(path_b: str) -> int:
    """Ids of the ``sentencepiece`` model."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
