"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where over half of its shingle hashes have it
set. Fingerprints that differ in at most ``radius`` bits are linked, and documents
take the smallest id that they reach.

Candidates. The 64 bits are cut into ``bands`` bands; two fingerprints within the
radius agree in at least ``bands - radius`` whole bands, so they meet in a bucket for
some choice of that many bands. This loses nothing; more bands give more, smaller
buckets, and their number is chosen from the count of distinct fingerprints. Equal
fingerprints are one row before anything is dealt out.

Comparison. Buckets are laid side by side into blocks of a few thousand rows; a
bucket larger than that is cut into chunks that meet pairwise. A block stores its
fingerprints vertically, one bit plane of 64-row words per bit. Each row is compared
with all others at once: a plane is flipped by the row's bit and added to carry-save
counters (ones, twos, and a flag for four or more); rows whose block lies beyond the
radius altogether are abandoned. Only a spanning forest of the links of a block
leaves the task, so a group of many near copies costs one row per member.

Defined cases: null or empty text, or white space alone, has no words and the
fingerprint zero, linked like any other; fewer words than a shingle give the whole
sequence as one; null ids are kept, but a component's id is the smallest that is not
null (null if there is none); repeated rows stay; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.blocks import pair_blocks
from tallyframe.llm.common import row_key, shuffle_width, staged
from tallyframe.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Rows per chunk; a block holds up to twice as many.
CHUNK_ROWS = 2048
#: Rows that a bucket is meant to hold on average, for the choice of bands.
BUCKET_ROWS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    # bytes.lower and bytes.split know ASCII only: A-Z and [\x20\x09-\x0D]
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        ends = (ends - 1).tolist()
        grams = [line[a:b] for a, b in zip(starts, ends[shingle - 1:])]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, rk, fp): one row per row of ``docs``; ``fp`` is the fingerprint as a
    signed long, ``rk`` a key of (doc_id, text)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(t, shingle, seed) for t in part.column(2).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], ["doc_id", "rk", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"),
                        F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, rk long, fp long"))


def bit_sliced_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fp`` (uint64), as pairs of positions."""
    n = len(fp)
    if n < 2:
        return []
    words = -(-n // 64)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")  # n x 64
    planes = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 64 * words - n), (0, 0))).T, axis=1,
                                              bitorder="little")).view("<u8")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    valid = np.full(words, full)
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    near: dict[int, np.ndarray] = {}
    depth = radius.bit_length() + 1 if radius & (radius + 1) else radius.bit_length()
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        over = np.broadcast_to(~valid, (len(rows), words)).copy()
        over[rows - at, rows // 64] |= np.uint64(1) << (rows % 64).astype(np.uint64)  # not with itself
        counters = [np.zeros((len(rows), words), np.uint64) for _ in range(depth)]
        flips = np.where(bits[rows] == 1, full, np.uint64(0))  # rows x 64
        for plane in range(64):
            carry = planes[plane][None, :] ^ flips[:, plane][:, None]
            for counter in counters:
                counter ^= carry
                carry &= ~counter  # where the old bit and the carry were both set
            over |= carry
            if plane % 8 == 7:
                alive = (over != full).any(axis=1)
                if not alive.all():  # these rows are further than the radius from the whole block
                    rows, over, flips = rows[alive], over[alive], flips[alive]
                    counters = [c[alive] for c in counters]
                    if not len(rows):
                        break
        if len(rows) and radius & (radius + 1):  # counters can hold more than the radius
            held = np.zeros((len(rows), 64 * words), np.uint8)
            for k, counter in enumerate(counters):
                held += np.unpackbits(np.ascontiguousarray(counter).view(np.uint8), axis=1, bitorder="little") << k
            over |= np.ascontiguousarray(np.packbits(held > radius, axis=1, bitorder="little")).view("<u8")
        for k, row in enumerate(rows.tolist()):
            if (over[k] != full).any():
                near[row] = ~over[k]
    # breadth first over the bit rows; each row is taken up once
    links, fresh = [], valid.copy()
    for root in near:
        if not int(fresh[root // 64]) >> root % 64 & 1:
            continue
        fresh[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
        queue = [root]
        while queue:
            found = near[queue.pop()] & fresh
            if found.any():
                fresh &= ~found
                got = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist()
                links += [(root, g) for g in got]
                queue += got
    return links


def band_count(distinct: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> int:
    """Bands such that buckets of ``distinct`` random fingerprints hold about
    ``bucket_rows`` rows: their keys have 64 * (bands - radius) / bands bits."""
    bands = radius + 1
    while bands < radius + 4 and distinct / 2 ** (64 * (bands - radius) / bands) > bucket_rows:
        bands += 1
    return bands


def links(distinct: DataFrame, radius: int = RADIUS, chunk_rows: int = CHUNK_ROWS, bands: int | None = None) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp``, enough to connect all
    that are connected."""
    spark = distinct.sparkSession
    count = distinct.count()
    bands = bands or band_count(count, radius)
    edges = [64 * b // bands for b in range(bands + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("_k")).select(
        "fp", F.col("_k.choice").alias("choice"), F.col("_k.value").alias("value"))
    blocks = pair_blocks(dealt, ["choice", "value"], chunk_rows, "fp")
    width = max(shuffle_width(spark), 1)
    # small buckets lie side by side: sorted by block, a task's rows form superblocks
    ordered = blocks.select("block", "fp").repartition(width, "block").sortWithinPartitions("block")
    limit = 2 * chunk_rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_block, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compare(fps: np.ndarray) -> pa.RecordBatch:
            fps = np.unique(fps)
            pairs = np.array(bit_sliced_links(fps.view("<u8"), radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": pa.array(fps[pairs[:, 0]]), "b": pa.array(fps[pairs[:, 1]])})

        for part in chain(parts, [None]):
            if part is not None:
                held_block = np.concatenate([held_block, part.column(0).to_numpy()])
                held_fp = np.concatenate([held_fp, part.column(1).to_numpy()])
            ends = np.flatnonzero(np.append(held_block[1:] != held_block[:-1], part is None)) + 1 if len(held_block) \
                else np.zeros(0, np.int64)
            # whole blocks as many as fit the limit; the last one may still go on
            start = 0
            while len(ends) and (part is None or ends[-1] - start >= limit):
                fit = ends[ends <= start + limit]
                stop = int(fit[-1]) if len(fit) else int(ends[0])
                yield compare(held_fp[start:stop])
                ends, start = ends[ends > stop], stop
            held_block, held_fp = held_block[start:], held_fp[start:]

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED,
                    chunk_rows: int = CHUNK_ROWS, bands: int | None = None) -> DataFrame:
    """(doc_id, rk, fp, group, component_id): one row per row of ``docs``. ``group`` is
    the smallest fingerprint of the group, which unlike an id is never shared."""
    fps = staged(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), radius, chunk_rows, bands))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("group"), "component_id")
    return fps.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "rk", "fp", "group", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest
    doc_id (nulls last), on ties the smallest row key; equal rows leave one."""
    columns = docs.columns
    # a group's best row is a minimum of partial aggregates: a hot group is one row per task
    best = near_duplicates(docs, **options).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("__sim_keep_id"), F.col("best.rk").alias("__sim_keep"))
    keyed = docs.withColumn("__sim_id", F.col("doc_id").cast("long")).withColumn("__sim_rk", row_key())
    kept = keyed.join(keep, (F.col("__sim_rk") == F.col("__sim_keep"))
                      & F.col("__sim_id").eqNullSafe(F.col("__sim_keep_id")), "left_semi")
    return kept.dropDuplicates(["__sim_id", "__sim_rk"]).select(*[F.col(f"`{c}`") for c in columns])
