"""Embedding near-duplicates by collision-counting projections.

Vectors are scaled to length one and projected on ``projections`` random directions.
In each direction the values of a block are sorted, and a query's window holds the
ranks whose value lies within ``window`` of its own. A pair collides in a direction
if one lies in the other's window; pairs with at least ``threshold`` collisions are
verified by their cosine in double precision. For a pair at the bound the difference
of two projections is normal with a known spread, so its collisions are binomial, and
the threshold is the largest that such a pair reaches with probability ``recall``.

Equal vectors are one class before anything is compared. Classes are dealt into lists
around centres (a bounded sample of the vectors): each is a query in the list of its
nearest centre, and a candidate in the lists of its ``spread`` nearest centres, where
``spread`` is calibrated so that linked pairs share a list with probability ``recall``:
``SAMPLE`` vectors are compared by brute force with all vectors, and their true links
count; half of the allowed loss is left to the sample's error. Partners made at the
bound are a lower limit, and if the sample has too few links to resolve ``recall``, so
are partners made in the directions in which the vectors themselves differ. The number
of centres follows the number of vectors, from ``LEAST_CENTRES`` on; the steps are the
same at every size. A list's queries and candidates are cut into chunks of bounded
size that meet pairwise, each in a task of its own.

A task returns sums of links per class and a spanning forest of its links, never all
pairs. A pair found from both of its lists is counted in one of them only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts
link with nothing and are their own component; vectors of different lengths do not
link; repeated rows are vectors of their own, linked to each other; a null id is never
a component's smallest, unless there is no other (then null); an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import shuffle_width, staged
from tallyframe.llm.components import Forest, components

BOUND = 0.9
PROJECTIONS = 32
#: Half a window's width, in standard deviations of a unit vector's projection.
WINDOW = 0.6
RECALL = 0.9995
#: Classes that a list is meant to hold, and the most centres (their broadcast bound).
LIST_ROWS = 4096
MAX_CENTRES = 16_384
#: The fewest centres: vectors are dealt into calibrated lists at every size of the input.
LEAST_CENTRES = 16
CHUNK_ROWS = 4096
SAMPLE = 2000
SEED = 7


def collision_threshold(bound: float, projections: int, window: float, recall: float) -> int:
    """Most collisions that a pair at cosine ``bound`` reaches with probability
    ``recall``: binomial, with the chance that a normal difference fits the window."""
    spread = math.sqrt(max(2 - 2 * bound, 1e-12))
    p = math.erf(window / spread / math.sqrt(2))
    tail, least = 0.0, projections
    while least > 0:
        tail += math.comb(projections, least) * p ** least * (1 - p) ** (projections - least)
        if tail >= recall:
            break
        least -= 1
    return least


def directions(dim: int, projections: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, projections))


def collisions(queries: np.ndarray, base: np.ndarray, window: float) -> np.ndarray:
    """Collisions of each query (rows of projections) with each base row: sort the
    base in every direction; a query's window is a range of ranks."""
    counts = np.zeros((len(queries), len(base)), np.uint8)
    rank = np.empty(len(base), np.uint16)
    for k in range(base.shape[1]):
        order = np.argsort(base[:, k], kind="stable")
        rank[order] = np.arange(len(base), dtype=np.uint16)
        values = base[order, k]
        low = np.searchsorted(values, queries[:, k] - window, "left").astype(np.uint16)
        high = np.searchsorted(values, queries[:, k] + window, "right").astype(np.uint16)
        # unsigned: ranks below the window wrap around to large numbers
        counts += (rank[None, :] - low[:, None]) < (high - low)[:, None]
    return counts


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` centres of largest cosine, best first."""
    cos = vectors @ centres.T
    n = min(n, len(centres))
    top = np.argpartition(-cos, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)


def made_spread(sample: np.ndarray, centres: np.ndarray, bound: float, recall: float, noise: np.ndarray) -> int:
    """Least number of lists per candidate such that sampled vectors and partners at
    cosine ``bound``, in the directions ``noise``, share a list, from either side, with
    probability ``recall``."""
    noise = noise - (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = bound * sample + math.sqrt(1 - bound * bound) * noise
    a, b = sample @ centres.T, partner @ centres.T
    # how far down the one's list the other's nearest centre lies; the better side counts
    at = np.arange(len(sample))
    down_b = (b > b[at, a.argmax(1)][:, None]).sum(1)
    down_a = (a > a[at, b.argmax(1)][:, None]).sum(1)
    return spread_of(np.bincount(np.minimum(down_a, down_b)), recall)


def spread_of(needs: np.ndarray, recall: float) -> int:
    """Lists per candidate that ``recall`` of the pairs need, from the number of pairs
    by how far down a list their shared centre lies."""
    return int(np.searchsorted(np.cumsum(needs), math.ceil(recall * needs.sum()))) + 1


def ranks(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How many centres are nearer to each vector than each centre, equal ones included."""
    out = np.empty((len(vectors), len(centres)), np.uint16)
    for at in range(0, len(vectors), 128):
        cos = vectors[at:at + 128] @ centres.T
        ordered = np.sort(cos, axis=1)
        for k, (row, own) in enumerate(zip(ordered, cos)):
            out[at + k] = len(centres) - 1 - np.searchsorted(row, own, "left")
    return out


def true_needs(classes: DataFrame, sample: np.ndarray, centres: np.ndarray, bound: float) -> np.ndarray:
    """All links of the sampled vectors, found by brute force, counted by how far down
    the one's list the other's nearest centre lies (the better side counts)."""
    dim, down = sample.shape[1], ranks(sample, centres)
    # SAMPLE vectors and at most MAX_CENTRES centres, and two bytes for each of their pairs
    shared = classes.sparkSession.sparkContext.broadcast((sample, sample.astype(np.float32), centres, down, down.argmin(1)))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, single, centres, down, home = shared.value
        needs = np.zeros(len(centres), np.int64)
        for part in slices(parts):
            v = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            # single precision with a margin; what it lets through is reckoned in double
            row, probe = np.nonzero(v.astype(np.float32) @ single.T >= bound - 1e-4)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            for r, own in zip(row[starts].tolist(), np.split(probe, starts[1:])):
                # a sampled vector is no link of itself, nor are its multiples any loss
                cos = sample[own] @ v[r]
                own = own[(cos >= bound) & (cos < 1 - 1e-12)]
                far = centres @ v[r]
                homes, at = np.unique(home[own], return_inverse=True)
                below = np.array([np.count_nonzero(far >= far[h]) - 1 for h in homes.tolist()], np.int64)
                needs += np.bincount(np.minimum(below[at], down[own, far.argmax()]), minlength=len(needs))
        held = np.flatnonzero(needs)
        yield pa.RecordBatch.from_pydict({"need": pa.array(held, pa.int64()), "n": pa.array(needs[held], pa.int64())})

    found = (classes.select("embedding").mapInArrow(count, "need long, n long").groupBy("need").agg(F.sum("n").alias("n"))
             .collect())
    needs = np.zeros(len(centres), np.int64)
    for r in found:
        needs[r["need"]] = r["n"]
    return needs


def calibrated_spread(classes: DataFrame, sample: np.ndarray, centres: np.ndarray, bound: float, recall: float,
                      seed: int = SEED) -> int:
    """Least number of lists per candidate at which linked pairs share a list with
    probability ``recall``."""
    rng = np.random.default_rng(seed)
    spread = made_spread(sample, centres, bound, recall, rng.standard_normal(sample.shape))
    needs = true_needs(classes, sample, centres, bound)
    if needs.sum() < 1 / (1 - recall):
        others = sample[rng.permutation(len(sample))]
        spread = max(spread, made_spread(sample, centres, bound, recall, others - sample))
    return max(spread, spread_of(needs, (1 + recall) / 2)) if needs.any() else spread


def slices(parts: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded size, none empty."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def usable(embedding: str = "embedding"):
    """Vectors that take part: no null or non-finite part, not all zero."""
    c = F.col(embedding)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, fine) & F.exists(c, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, bound: float = BOUND, projections: int = PROJECTIONS, window: float = WINDOW,
                    recall: float = RECALL, list_rows: int = LIST_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding): one row per row with vec_id, n_links,
    component_id, kept."""
    spark = vectors.sparkSession
    # single precision stays so while it is shuffled; all reckoning is in double
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("fine", usable())
    # the node number is fixed once written
    classes = staged(rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
                     .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    dims = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]
    found = [_links(classes.where(F.size("embedding") == d), d, bound, projections, window, recall, list_rows, chunk_rows)
             for d in sorted(dims)]
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
    else:
        links = spark.createDataFrame([], "a long, b long, n long")
    links = staged(links, "vector-links")
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "_node")
    roots = components(links.where("b is not null").select("a", "b"))
    classes = (classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
               .join(counts, F.col("node") == F.col("_node"), "left"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "root").select(
        F.col("embedding").alias("_of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = (rows.where("fine").join(classes, F.col("embedding") == F.col("_of"))
           .select("vec_id", "n_links", "component_id"))
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, bound: float, projections: int, window: float, recall: float,
           list_rows: int, chunk_rows: int) -> DataFrame:
    """Rows (a, b, null) of a spanning forest and (a, null, n) of link counts."""
    spark, kind = classes.sparkSession, classes.schema["embedding"].dataType.simpleString()
    n = classes.count()
    # a bounded sample, the same in every run: the smallest hashes
    wanted = min(MAX_CENTRES, max(LEAST_CENTRES, n // list_rows))
    picked = (classes.select("embedding").orderBy(F.xxhash64("node", F.lit("centre"))).limit(wanted + SAMPLE)
              .toPandas()["embedding"])
    picked = np.array([np.asarray(v, np.float64) for v in picked])
    picked /= np.linalg.norm(picked, axis=1, keepdims=True)
    # vectors that the sample can hold are all in it, centres as well
    centres, sample = picked[:wanted], picked[wanted:] if n > SAMPLE else picked
    spread = min(calibrated_spread(classes, sample, centres, bound, recall), len(centres))
    projected = directions(dim, projections)
    threshold = collision_threshold(bound, projections, window, recall)
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_CENTRES vectors

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            lists = nearest(v, shared.value, spread).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(1),
                 pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), lists.ravel())],
                ["node", "copies", "embedding", "lists"])

    dealt = (classes.select("node", "embedding", "copies")
             .mapInArrow(deal, f"node long, copies long, embedding {kind}, lists array<int>"))
    dealt = staged(dealt, "vector-lists")
    # chunks of each list, from counts of its queries and candidates
    sizes = (dealt.select(F.posexplode("lists").alias("pos", "list")).groupBy("list")
             .agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("base_chunks"),
                  F.greatest(F.lit(1), F.ceil(F.sum((F.col("pos") == 0).cast("int")) / chunk_rows)).cast("int")
                  .alias("query_chunks")))
    member = (dealt.select("node", "copies", "embedding", "lists", F.posexplode("lists").alias("pos", "list"))
              .join(sizes, "list"))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("base_chunks"))
    chunk_of_query = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("query_chunks"))
    base = member.select("list", "node", "copies", "embedding", "lists", F.lit(False).alias("query"), chunk.alias("b"),
                         F.explode(F.expr("sequence(0, query_chunks - 1)")).alias("q"))
    queries = member.where("pos = 0").select(
        "list", "node", "copies", "embedding", "lists", F.lit(True).alias("query"),
        F.explode(F.expr("sequence(0, base_chunks - 1)")).alias("b"), chunk_of_query.alias("q"))
    tasks = base.select(*queries.columns).union(queries)

    def compare(table: pa.Table) -> pa.Table:
        isq = table.column("query").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        v = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        p = v @ projected
        home = table.column("list")[0].as_py() if table.num_rows else 0
        lists = table.column("lists").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        qs, bs = np.flatnonzero(isq), np.flatnonzero(~isq)
        forest, a, b = Forest(len(node)), [], []
        # a node may be here as query and as candidate: one tree
        same: dict[int, int] = {}
        for k, x in enumerate(node.tolist()):
            forest.join(same.setdefault(x, k), k)
        total = np.zeros(len(node), np.int64)
        for at in range(0, len(qs), 512):
            q = qs[at:at + 512]
            hit_q, hit_b = np.nonzero(collisions(p[q], p[bs], window) >= threshold)
            x, y = q[hit_q], bs[hit_b]
            # blocks of pairs, so that a dense group does not fill the memory
            for k in range(0, len(x), 100_000):
                i, j = x[k:k + 100_000], y[k:k + 100_000]
                ok = (np.einsum("ij,ij->i", v[i], v[j]) >= bound) & (node[i] != node[j])
                i, j = i[ok], j[ok]
                # also found from the other side? then the smaller node's list counts it
                other = (lists[i] == lists[j, 0][:, None]).any(axis=1)
                mine = ~other | (node[i] < node[j])
                np.add.at(total, i[mine], copies[j[mine]])
                np.add.at(total, j[mine], copies[i[mine]])
                for s, t in zip(i.tolist(), j.tolist()):
                    if forest.join(s, t):
                        a.append(node[s])
                        b.append(node[t])
        with_links = np.flatnonzero(total)
        return pa.table({
            "a": pa.array(np.concatenate([np.array(a, np.int64), node[with_links]])),
            "b": pa.array([*map(int, b), *[None] * len(with_links)], pa.int64()),
            "n": pa.array([*[None] * len(a), *total[with_links].tolist()], pa.int64())})

    return (tasks.repartition(4 * shuffle_width(spark), "list", "b", "q").groupBy("list", "b", "q")
            .applyInArrow(compare, "a long, b long, n long"))
