"""Nearest neighbours by adaptive dimension scan over inverted lists.

Fitting takes a bounded sample: centres by a few rounds of k-means, and a random
rotation. Indexing puts every vector into the list of its nearest centre, lists cut
into chunks of bounded size. A query probes the lists of its nearest centres; the
queries of a list are cut into parts, so that a task holds one chunk and one part
however popular the list is. Vectors are shuffled in the column's own precision. Within
a chunk the rotated vectors are read in blocks of columns; after each block a candidate
whose partial distance, scaled up to all dimensions, exceeds the query's tenth best by
the test's margin is abandoned (the partial distance of a randomly rotated vector
estimates the whole one, with an error that shrinks with the root of the dimensions
read). Candidates that last get their exact distance on the original vectors in double
precision, and the best ``k`` over all chunks are the result.

The number of probed lists is calibrated on sampled vectors against brute force over
the sample: enough that ``recall`` of the true neighbours lie in probed lists.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts
take no part, nor do those whose length differs from the most frequent one (the
smaller on ties); a query is never its own candidate (by vec_id); ties go to the
smaller vec_id; rows with a null id are candidates of nobody; repeated rows count as
often as they occur, but one result set is given per query id (of rows with the same
id, the smallest vector asks); fewer candidates than ``k`` give them all; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallyframe.llm.common import shuffle_width, staged
from tallyframe.llm.embedding_dups import slices, usable

SAMPLE = 20_000
MAX_CENTRES = 4096
LIST_ROWS = 1024
CHUNK_ROWS = 4096
#: Queries of a list that a task holds.
PART_ROWS = 4096
RECALL = 0.98
COLUMNS = 16
#: Margin of the abandoning test: a candidate goes when its partial distance exceeds
#: the bound by the factor 1 + EPSILON / sqrt(dimensions read).
EPSILON = 2.1
SEED = 11


class Index:
    """Centres, rotation and number of probes, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, recall: float = RECALL, list_rows: int = LIST_ROWS,
                 seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        n = max(1, min(MAX_CENTRES, rows // list_rows, len(sample) // 8))
        self.centres = sample[rng.permutation(len(sample))[:n]].copy()
        for _ in range(8):
            home = _distances(sample, self.centres).argmin(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, home, sample)
            held = np.bincount(home, minlength=n)
            self.centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], self.centres)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.probes = self._calibrated(sample, k, recall)

    def _calibrated(self, sample: np.ndarray, k: int, recall: float) -> int:
        home = _distances(sample, self.centres).argmin(1)
        tested = sample[:1000]
        d = _distances(tested, sample)
        d[np.arange(len(tested)), np.arange(len(tested))] = np.inf
        best = np.argsort(d, axis=1)[:, :min(k, len(sample) - 1)] if len(sample) > 1 else np.zeros((len(tested), 0), int)
        if not best.size:
            return len(self.centres)
        to_centres = _distances(tested, self.centres)
        need = (to_centres[:, :, None] < np.take_along_axis(to_centres, home[best], 1)[:, None, :]).sum(1)
        need = np.sort(need.ravel())
        # the sample is thinner than the table, so its neighbours lie further off: safe
        return min(len(self.centres), int(need[math.ceil(recall * len(need)) - 1]) + 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def scan(query: np.ndarray, base: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Positions in ``base`` (rotated) that last the adaptive scan for ``query``
    (rotated). The first ``k`` candidates give the first bound."""
    dim = base.shape[1]
    if len(base) <= k:
        return np.arange(len(base))
    first = ((base[:4 * k] - query) ** 2).sum(1)
    bound = np.partition(first, k - 1)[k - 1]
    alive, partial = np.arange(len(base)), np.zeros(len(base))
    for at in range(0, dim, columns):
        part = base[alive, at:at + columns] - query[at:at + columns]
        partial = partial + np.einsum("ij,ij->i", part, part)
        seen = min(at + columns, dim)
        if seen == dim:
            keep = partial <= bound * (1 + 1e-9)
        else:
            keep = partial * (dim / seen) <= bound * (1 + epsilon / math.sqrt(seen)) ** 2
        alive, partial = alive[keep], partial[keep]
        if seen < dim and len(alive) > k:
            # a tighter bound from the most promising candidates so far
            ahead = alive[np.argpartition(partial, k - 1)[:k]]
            bound = min(bound, ((base[ahead] - query) ** 2).sum(1).max())
    return alive


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, sample: int = SAMPLE,
           list_rows: int = LIST_ROWS, chunk_rows: int = CHUNK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row of
    ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    held = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind = "array<float>" if isinstance(held, FloatType) else "array<double>"
    rows = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"),
        "_q").where(usable() & F.col("vec_id").isNotNull())
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    if not lengths:
        return spark.createDataFrame([], empty)
    dim, n = lengths[0]
    rows = rows.where(F.size("embedding") == dim)
    picked = rows.select("embedding").orderBy(F.xxhash64("vec_id", F.lit("sample"))).limit(sample).toPandas()["embedding"]
    index = Index(np.array([np.asarray(v, np.float64) for v in picked]), n, k, recall, list_rows)
    # at most MAX_CENTRES vectors and a rotation
    shared = spark.sparkContext.broadcast((index.centres, index.rotation, index.probes))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, n_probes = shared.value
        row = TaskContext.get().partitionId() << 40
        for part in slices(parts):
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            order = np.argsort(_distances(v, centres), axis=1, kind="stable")[:, :n_probes].astype(np.int32)
            asks = part.column(2).to_pylist()
            probes = [row.tolist() if q else None for q, row in zip(asks, order)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(order[:, 0]), pa.array(probes, pa.list_(pa.int32())),
                 pa.array(range(row, row + len(v)), pa.int64())], ["vec_id", "embedding", "list", "probes", "row"])
            row += len(v)

    dealt = staged(rows.mapInArrow(deal, f"vec_id long, embedding {kind}, list int, probes array<int>, row long"), "ann-lists")
    # of rows that repeat a query's id the one with the smallest vector asks
    asking = (dealt.where("probes is not null").groupBy("vec_id")
              .agg(F.min(F.struct("embedding", "probes")).alias("r")).select("vec_id", "r.embedding", "r.probes"))
    asking = asking.select("vec_id", "embedding", F.explode("probes").alias("list"))
    # one row for each of at most MAX_CENTRES lists that hold a vector and are asked for
    sizes = (dealt.groupBy("list").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
             .join(asking.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")), "list"))
    # dealt by the row's number, so that equal rows part as well
    base = dealt.join(sizes, "list").select(
        "list", F.expr("cast(pmod(xxhash64('chunk', row), chunks) as int)").alias("chunk"),
        F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "vec_id", "embedding", F.lit(False).alias("query"))
    queries = asking.join(sizes, "list").select(
        "list", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"),
        F.expr("cast(pmod(xxhash64('part', vec_id), parts) as int)").alias("part"), "vec_id", "embedding",
        F.lit(True).alias("query"))

    def probe(table: pa.Table) -> pa.Table:
        isq, ids = table.column("query").to_numpy(), table.column("vec_id").to_numpy()
        v = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        b = np.flatnonzero(~isq)
        b = b[np.lexsort((ids[b],))]  # the same order in every run
        turned = v @ shared.value[1]
        base_turned = np.ascontiguousarray(turned[b])
        out_q, out_v, out_s = [], [], []
        for q in np.flatnonzero(isq).tolist():
            # the query itself is among the candidates of its own list: one more lasts
            last = b[scan(turned[q], base_turned, k + int((ids[b] == ids[q]).sum()))]
            last = last[ids[last] != ids[q]]
            diff = v[last] - v[q]
            score = np.sqrt((diff * diff).sum(1))
            best = np.lexsort((ids[last], score))[:k]
            out_q += [ids[q]] * len(best)
            out_v += ids[last[best]].tolist()
            out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})

    found = (base.union(queries).repartition(2 * shuffle_width(spark), "list", "chunk", "part").groupBy("list", "chunk", "part")
             .applyInArrow(probe, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
