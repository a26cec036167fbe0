"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of ``(h1, h2, docs)``: the 128-bit hash of a line key and the
documents that hold it, sorted by hash. Documents arrive in batches. A batch's
distinct keys are merge-anti-joined with the keys that the runs already hold as
repeated, and the others become a run of level 0. When a level has ``fanout`` runs,
they are compacted: merged by hash, counts added, into one run of the next level. A
key is repeated when its counts reach ``min_docs`` over all runs; ``clean`` then
drops every line of a repeated key, in every document.

The key of a line is the line without ASCII white space at both ends, ``A-Z`` in
lower case; a key of fewer than ``min_chars`` code points never counts. A line that
occurs often inside one document counts once for it. Counting is by partial
aggregation, so a line that a third of all documents share is one row per task.

Defined cases: null or empty text is one empty line, kept; every row is a document,
so repeated rows count as often as they occur; an empty table gives no rows; other
columns pass through ``clean`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import new_folder, row_key
from tallyframe.llm.words import steps

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 4
BATCHES = 4
#: Bytes of text that a task has in hand at once (a longer text alone).
STEP_BYTES = 2_000_000

KEYS = "h1 long, h2 long, docs long"


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None where the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        # bytes.strip and bytes.lower know ASCII only: [\x20\x09-\x0D] and A-Z
        key = line.strip().lower()
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


class LineRuns:
    """The runs of one corpus, kept as Parquet folders below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS,
                 fanout: int = FANOUT):
        self.spark, self.folder = spark, folder or new_folder(spark, "line-runs")
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(*paths)

    def _write(self, keys: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        # the aggregate has dealt the keys by hash; each part is one sorted stretch
        keys.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def repeated(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more."""
        paths = [p for level in self.levels for p in level]
        counts = self._read(paths) if len(paths) == 1 else self._merged(paths)
        return counts.where(F.col("docs") >= self.min_docs)

    def add(self, keys: DataFrame) -> None:
        """Take in a batch: rows (h1, h2), one per line key and document."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        if any(self.levels):
            counts = counts.join(self.repeated().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        self.compact()

    def compact(self, everything: bool = False) -> None:
        """Merge each full level (or all levels) into one run of the next."""
        if everything:
            paths = [p for level in self.levels for p in level]
            if len(paths) > 1:
                top = len(self.levels)
                merged = self._merged(paths)
                self.levels = [[] for _ in range(top)]
                self._write(merged, top)
            return
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                paths, self.levels[level] = self.levels[level], []
                self._write(self._merged(paths), level + 1)
            level += 1


def _keys(docs: DataFrame, min_chars: int, batches: int, path: str) -> DataFrame:
    """Stage (batch, row key, h1, h2), one row per distinct line key of a document."""
    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.column(0).to_numpy()
            for start, texts in steps(part.column(1), STEP_BYTES):
                own = [b"".join({h for h in line_hashes(t, min_chars) if h is not None}) for t in texts.to_pylist()]
                halves = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
                row = np.repeat(rows[start:start + len(own)], [len(x) // 16 for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                                                 ["row", "h1", "h2"])

    (docs.select(row_key(), F.col("text").cast("string")).mapInArrow(hashes, "row long, h1 long, h2 long")
     .withColumn("batch", F.expr(f"cast(pmod(row, {batches}) as int)"))
     .write.partitionBy("batch").parquet(path))
    return docs.sparkSession.read.schema("row long, h1 long, h2 long, batch int").parquet(path)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
          fanout: int = FANOUT, digest: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines`` (before),
    ``n_dropped``. With ``digest``: doc_id, n_lines, n_dropped, kept_sha256."""
    spark = docs.sparkSession
    names = [f for f in docs.columns if f not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    staged_keys = _keys(docs, min_chars, batches, new_folder(spark, "line-keys"))
    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout)
    for b in range(batches):
        runs.add(staged_keys.where(F.col("batch") == b).select("h1", "h2"))
    runs.compact(everything=True)
    repeated = runs.repeated().select("h1", "h2")
    # a document's dropped keys: both sides are shuffled tables, so AQE splits the rows
    # of a very common line over tasks; then they are gathered per document
    drops = (staged_keys.join(repeated.hint("merge"), ["h1", "h2"], "left_semi")
             .groupBy("row").agg(F.collect_set(F.struct("h1", "h2")).alias("__ld_drops"))
             .withColumnRenamed("row", "__ld_of"))
    keyed = docs.withColumn("__ld_row", row_key())
    joined = keyed.join(drops, F.col("__ld_row") == F.col("__ld_of"), "left").drop("__ld_row", "__ld_of")
    if digest:
        joined = joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                               "__ld_drops")
        schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    else:
        fields = [f for f in joined.schema.fields if f.name != "__ld_drops"]
        schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = joined.columns.index("text")

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = part.column(part.num_columns - 1)
            flat = sets.flatten()
            # 16 bytes for each dropped key, and where each document's keys end
            keys = np.stack([flat.field(k).to_numpy() for k in (0, 1)], 1).astype("<i8").tobytes()
            ends = np.cumsum(pc.list_value_length(sets).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) * 16
            for start, texts in steps(part.column(at), STEP_BYTES):
                rows, lines, dropped = texts.to_pylist(), [], []
                for i, text in enumerate(rows):
                    first, last = int(ends[start + i - 1]) if start + i else 0, int(ends[start + i])
                    lines.append(text.count("\n") + 1)
                    dropped.append(0)
                    if last > first:
                        gone = {keys[k:k + 16] for k in range(first, last, 16)}
                        kept = [x for x, h in zip(text.split("\n"), line_hashes(text, min_chars)) if h not in gone]
                        dropped[-1] = lines[-1] - len(kept)
                        rows[i] = "\n".join(kept)
                own = part.slice(start, len(rows))
                counts = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                if digest:
                    sha = [hashlib.sha256(t.encode()).hexdigest() for t in rows]
                    yield pa.RecordBatch.from_arrays([own.column(0), *counts, pa.array(sha, pa.string())], schema.names)
                else:
                    cols = [own.column(k) for k in range(own.num_columns - 1)]
                    empty = cols[at].is_null().to_pylist()  # a null text stays null
                    cols[at] = pa.array([None if e else t for e, t in zip(empty, rows)], cols[at].type)
                    yield pa.RecordBatch.from_arrays([*cols, *counts], schema.names)

    return joined.mapInArrow(drop, schema)
