"""Token-id files: patched frame-of-reference blocks with an index of block starts.

File format. A dataset is a Parquet folder of segments, in ascending document order
by ``(shard, segment)``. One segment holds whole documents of about ``SEGMENT_IDS``
ids together: their ids and lengths, the ids that lie before it in its shard, and
one binary ``payload``::

    "PFR1" | u32 block length | u64 ids | u64 start of each block ... | blocks
    block: u32 minimum | u8 width | u8 exceptions | width-bit packed offsets
           | exceptions x u8 positions | exceptions x u32 high parts

Every block subtracts its minimum and packs the offsets at the bit width that fits
the ``percentile`` of them; the bits of larger offsets above that width go to the
exception list. Any block is read alone through the index. Parquet as container makes
the write atomic (Spark's committer) and readable in any store.

Defined cases: null text is empty (only the end id); null document ids sort first;
repeated ids are kept, ordered by a hash of their text; an empty table gives an empty
dataset; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.chunk_encoder import library_encoder
from tallyframe.llm.common import new_folder, row_key, shuffle_width
from tallyframe.llm.words import steps

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 262_144
#: Bytes of text encoded at a time (memory only).
STEP_BYTES = 6_000_000
MAGIC = b"PFR1"

SEGMENT_SCHEMA = ("shard int, segment int, before long, n_ids long, doc_ids array<bigint>, "
                  "doc_lens array<bigint>, payload binary")


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of unsigned values."""
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) + 1, 0)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload of ``ids`` (uint32)."""
    n = len(ids)
    nb = -(-n // block)
    head = MAGIC + np.uint32(block).tobytes() + np.uint64(n).tobytes()
    if not n:
        return head
    padded = np.concatenate([ids, np.full(nb * block - n, ids[-1], ids.dtype)]).reshape(nb, block)
    low = padded.min(axis=1)
    off = (padded - low[:, None]).astype(np.uint32)
    k = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = _bits(np.partition(off, k, axis=1)[:, k])
    high = np.where(width[:, None] < 32, off >> np.minimum(width, 31)[:, None], 0).astype(np.uint32)
    exc_row, exc_pos = np.nonzero(high)
    n_exc = np.bincount(exc_row, minlength=nb)
    packed_len = width * block // 8
    size = 6 + packed_len + 5 * n_exc
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.zeros(int(size.sum()), np.uint8)
    header = np.concatenate([low.astype("<u4").view(np.uint8).reshape(nb, 4), width[:, None].astype(np.uint8),
                             n_exc[:, None].astype(np.uint8)], axis=1)
    out[start[:, None] + np.arange(6)] = header
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.empty((len(rows), block, w), np.uint8)
            for b in range(w):
                bits[:, :, b] = (off[rows] >> np.uint32(b)) & np.uint32(1)
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            out[(start[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    nth = np.arange(len(exc_row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    lists = (start + 6 + packed_len)[exc_row]
    out[lists + nth] = exc_pos
    values = high[exc_row, exc_pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(lists + n_exc[exc_row] + 4 * nth)[:, None] + np.arange(4)] = values
    return head + start.astype("<u8").tobytes() + out.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (excluded), all by default; only these
    blocks are touched, found by the index."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token-id payload")
    block = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    n = int(np.frombuffer(payload, "<u8", 1, 8)[0])
    nb = -(-n // block)
    last = nb if last is None else min(last, nb)
    if first >= last:
        return np.zeros(0, np.uint32)
    start = np.frombuffer(payload, "<u8", nb, 16)[first:last].astype(np.int64)
    data = np.frombuffer(payload, np.uint8, offset=16 + 8 * nb)
    low = data[start[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, n_exc = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    off = np.zeros((len(start), block), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = data[(start[rows] + 6)[:, None] + np.arange(w * block // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), block, w)
            acc = np.zeros((len(rows), block), np.uint32)
            for b in range(w):
                acc |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            off[rows] = acc
    row = np.repeat(np.arange(len(start)), n_exc)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    lists = (start + 6 + width * block // 8)[row]
    pos = data[lists + nth]
    values = data[(lists + n_exc[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    off[row, pos] |= (values << width[row].astype(np.uint32)).astype(np.uint32)
    ids = (off + low[:, None]).ravel()
    return ids[:n - first * block] if last == nb else ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, block: int = BLOCK,
          percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the dataset to ``path`` in ascending
    doc_id order. Documents are dealt into ranges of (doc_id, text hash), so that ties
    cannot pile up in one range; a range is streamed, one segment in memory at a time."""
    tail = b"" if end_id is None else np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, segment, shard = library_encoder(tokenizer), 0, 0, 0
        doc_ids: list = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "doc_lens": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                "payload": pa.array([pack(ids, block, percentile)], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for at, texts in steps(batch.column(1), STEP_BYTES):
                for doc_id, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), encoder.encode(texts)):
                    doc_ids.append(doc_id)
                    parts.append(ids + tail)
                    held += len(ids) // 4 + len(tail) // 4
                    if held >= segment_ids:
                        yield flush()
                        before, segment, held = before + held, segment + 1, 0
                        doc_ids, parts = [], []
        if doc_ids:
            yield flush()

    n = shuffle_width(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("_tie", row_key())
               .repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
               .select("doc_id", "text", F.spark_partition_id().alias("shard")))
    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the dataset, decoded from its blocks: doc_id, ``start``
    (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row per shard: as many as write tasks
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4").tobytes()
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(ends - lens + row["base"] + row["before"], pa.int64()),
                    "n_tokens": pa.array(lens, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    # base: a row of two numbers per write task
    return (segments.join(F.broadcast(base), "shard").select("base", "before", "doc_ids", "doc_lens", "payload")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new dataset in the shared folder and read it back."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
