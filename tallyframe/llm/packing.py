"""Mixture-controlled packing of documents into fixed-length token sequences.

Documents are encoded once, where they are read, and staged with their ids. One
aggregate gives the tokens of every source, whose shares of the corpus are the target
of every window (or the given shares are). Rows are then dealt into lanes by a hash of
the row and its number in its task, so that neither a source nor a row that is repeated
a million times fills a lane.

A lane keeps one queue of documents per source and fills windows of
``window_sequences`` sequences by deficit round-robin: a window credits every source
its target share of the window; the source furthest in credit gives tokens from its
queue, at most its credit (``quantum`` at least), and documents are cut freely. Credit
that a source could not use, or overdrew, is carried to the next window. What a lane
cannot place in proportion, because one of its queues has run out, goes up, but no more
than a window or the ``fan_in``-th part of the lane, so that the group of ``fan_in``
lanes above is no larger than a lane or ``fan_in`` windows; so does the last piece of a
sequence. With it go the lane's deficits: each source's target share of all tokens
placed, less its own. Groups of lanes continue from their summed deficits, level by level, until one
group is left, whose last sequence alone is padded (not if it holds a power of two).

Beyond ``MAX_SOURCES`` sources, queues and targets are those of hashes of the source;
every document is still packed.

Defined cases: null text is empty, so the document is its end id alone; a null source
is a source of its own; a source without a given share is packed where the others leave
room; repeated rows are packed as often as they occur; an empty table gives no pieces;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.chunk_encoder import library_encoder
from tallyframe.llm.common import row_key, shuffle_width, staged

SEQUENCE = 2048
WINDOW_SEQUENCES = 16
QUANTUM = 512
LANE_BYTES = 4_000_000
FAN_IN = 16
#: Sources with a queue of their own.
MAX_SOURCES = 1000
#: Bytes of text encoded at a time (memory only).
STEP_BYTES = 6_000_000

#: A piece row has ``sequence_id``; a row without one is a rest that goes up a level.
OUT = ("lane long, doc_id long, source string, queue string, start long, length long, ids_crc32 long, doc_tokens long, "
       "sequence_id long, offset long, ids binary, credits map<string,double>")
READ = ("doc_id", "source", "queue", "start", "ids", "doc_tokens")
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]


def deficit_round_robin(queues: dict[str, deque], shares: dict[str, float], credit: dict[str, float],
                        sequence: int, window_sequences: int, quantum: int):
    """Yield ``(doc, start, length, sequence number, offset)`` for all tokens of
    ``queues`` (source -> deque of ``[doc, start, length]``), filling windows to
    ``shares``. ``credit`` is updated in place and holds what is carried on."""
    window = sequence * window_sequences
    room, at = 0, 0  # tokens left in the window; tokens given so far
    left = {s: q for s, q in queues.items() if q}
    while left:
        if not room:
            room = window
            for s, share in shares.items():
                credit[s] = credit.get(s, 0.0) + share * window
        s = max(left, key=lambda k: credit.get(k, 0.0))
        queue = left[s]
        doc, start, length = queue[0]
        take = min(length, room, max(quantum, int(credit.get(s, 0.0))))
        given = 0
        while given < take:  # a sequence boundary cuts as well
            n = min(take - given, sequence - at % sequence)
            yield doc, start + given, n, at // sequence, at % sequence
            given, at = given + n, at + n
        credit[s] = credit.get(s, 0.0) - take
        room -= take
        if take == length:
            queue.popleft()
            if not queue:
                del left[s]
        else:
            queue[0] = [doc, start + take, length - take]


def _pack(level: int, lane: int, docs: list[tuple], shares: dict[str, float], credit: dict[str, float],
          last: bool, sequence: int, window_sequences: int, quantum: int, fan_in: int, unit: str) -> pa.Table:
    """``docs``: rows of ``READ`` in queue order, ids in numpy's type ``unit``."""
    width = np.dtype(unit).itemsize
    queues: dict[str, deque] = {}
    for k, (_, _, queue, _, raw, _) in enumerate(docs):
        queues.setdefault(queue, deque()).append([k, 0, len(raw) // width])
    given = list(deficit_round_robin(queues, shares, dict(credit), sequence, window_sequences, quantum))
    total = sum(n for _, _, n, _, _ in given)
    # placed in proportion until the first queue runs out; what goes up is bounded
    ends = {docs[k][2]: number for k, _, _, number, _ in given}
    full = (total - 1) // sequence  # something always goes up, with the deficits
    kept = max(min([full, *(number + 1 for s, number in ends.items() if shares.get(s))]), full - max(window_sequences, full // fan_in))
    placed: dict[str, int] = {}
    for k, _, n, number, _ in given:
        if last or number < kept:
            placed[docs[k][2]] = placed.get(docs[k][2], 0) + n
    done = sum(placed.values())
    balance = {s: credit.get(s, 0.0) + shares.get(s, 0.0) * done - placed.get(s, 0)
               for s in {*shares, *placed, *credit}}
    cols: dict[str, list] = {name: [] for name in ("doc_id", "source", "queue", "start", "length", "ids_crc32", "doc_tokens",
                                                   "sequence_id", "offset", "ids")}
    base = level << 58 | lane << 24
    for k, start, n, number, offset in given:
        doc_id, source, queue, first, raw, doc_tokens = docs[k]
        up = number >= kept and not last
        ids = raw[width * start:width * (start + n)]
        for name, value in (("doc_id", doc_id), ("source", source), ("queue", queue), ("start", first + start), ("length", n),
                            ("ids_crc32", zlib.crc32(np.frombuffer(ids, unit).astype("<u4"))), ("doc_tokens", doc_tokens),
                            ("sequence_id", None if up else base + number), ("offset", None if up else offset),
                            ("ids", ids if up else None)):
            cols[name].append(value)
    rows = len(cols["doc_id"])
    rest = rows and cols["sequence_id"][-1] is None
    carried = [None] * (rows - 1) + [sorted(balance.items()) if rest else None] if rows else []
    i64, string = pa.int64(), pa.string()
    return pa.table({
        "lane": pa.array([lane] * rows, i64), "doc_id": pa.array(cols["doc_id"], i64),
        "source": pa.array(cols["source"], string), "queue": pa.array(cols["queue"], string), "start": pa.array(cols["start"], i64),
        "length": pa.array(cols["length"], i64), "ids_crc32": pa.array(cols["ids_crc32"], i64),
        "doc_tokens": pa.array(cols["doc_tokens"], i64), "sequence_id": pa.array(cols["sequence_id"], i64),
        "offset": pa.array(cols["offset"], i64), "ids": pa.array(cols["ids"], pa.binary()),
        "credits": pa.array(carried, pa.map_(string, pa.float64()))})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, shares: dict[str, float] | None = None,
         sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, quantum: int = QUANTUM,
         lane_bytes: int = LANE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source, sequence_length (padded). Every id of every document, its end id
    included, lies in exactly one piece."""
    spark = docs.sparkSession
    # ids of small vocabularies are staged and shuffled in two bytes
    unit = "<u2" if max(len(library_encoder(tokenizer).starts) - 1, end_id) < 2 ** 16 else "<u4"
    end = np.array([end_id], unit).tobytes()
    cut = (sequence, window_sequences, quantum, fan_in, unit)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source"), row_key().alias("deal"))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = library_encoder(tokenizer), TaskContext.get().partitionId() << 40
        for part in parts:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < part.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_BYTES, "right")))
                own = part.slice(at, stop - at)
                ids = [np.frombuffer(raw, "<u4").astype(unit).tobytes() + end for raw in encoder.encode(own.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), own.column(3), pa.array(range(row, row + len(ids)), pa.int64()),
                     pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "deal", "row", "doc_tokens", "ids"])
                row, at = row + len(ids), stop

    # the row number parts equal rows; staged, so that a retried task deals them the same way
    ids = staged(docs.mapInArrow(encode, "doc_id long, source string, deal long, row long, doc_tokens long, ids binary"),
                 "packing-ids")
    per_source = ids.groupBy("source").agg(F.sum("doc_tokens").alias("tokens"))
    if per_source.count() > MAX_SOURCES:
        queue = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(MAX_SOURCES)))
        per_source = per_source.groupBy(queue.alias("source")).agg(F.sum("tokens").alias("tokens"))
    else:
        queue = F.col("source")
    tokens = {r.source: r.tokens for r in per_source.collect()}  # at most MAX_SOURCES rows
    size = 4 * sum(tokens.values())
    lanes = max(1, -(-size // lane_bytes))
    if shares is None:
        target = {s: 4 * n / size for s, n in tokens.items()}
    else:
        target = {f"={s}": w / sum(shares.values()) for s, w in shares.items()}
        queue = F.col("source")

    def fill(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        lane = table.column("lane")[0].as_py()
        table = table.sort_by([("deal", "ascending"), ("row", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in READ)))
        return _pack(0, lane, rows, target, {}, lanes == 1, *cut)

    def refill(level: int, last: bool):
        def refill_group(table: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table
            lane = table.column("up")[0].as_py()
            table = table.sort_by([("lane", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            credit: dict[str, float] = {}
            for carried in table.column("credits").to_pylist():
                for s, c in carried or ():
                    credit[s] = credit.get(s, 0.0) + c
            rows = list(zip(*(table.column(c).to_pylist() for c in READ)))
            return _pack(level, lane, rows, target, credit, last, *cut)
        return refill_group

    dealt = (ids.withColumn("deal", F.xxhash64("deal", "row")).withColumn("queue", queue)
             .withColumn("start", F.lit(0).cast("long"))
             .withColumn("lane", F.expr(f"pmod(xxhash64(deal, 'lane'), {lanes}L)"))
             .repartition(max(1, min(lanes, 4 * shuffle_width(spark))), "lane"))
    done = [staged(dealt.groupBy("lane").applyInArrow(fill, OUT), "packing")]
    level = 0
    while lanes > 1:
        lanes, level = -(-lanes // fan_in), level + 1

        rests = (done[-1].where("sequence_id is null")
                 .withColumn("up", F.expr(f"cast(floor(lane / {fan_in}) as bigint)")))
        done.append(staged(rests.groupBy("up").applyInArrow(refill(level, lanes == 1), OUT), "packing"))
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    pieces = pieces.where("sequence_id is not null").select(*PIECE)
    pieces = pieces.withColumn("source", F.expr("if(source = '', null, substring(source, 2))"))
    # only the last sequence of the last level can be short
    held = (done[-1].where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("held"))
            .where(F.col("held") < sequence).withColumnRenamed("sequence_id", "short_id"))
    power = F.expr("(held & (held - 1)) = 0")
    return (pieces.join(F.broadcast(held), pieces["sequence_id"] == held["short_id"], "left")
            .withColumn("sequence_length", F.when(F.col("held").isNotNull() & power, F.col("held"))
                        .otherwise(F.lit(sequence).cast("long"))).drop("held", "short_id"))
