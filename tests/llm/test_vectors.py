import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import ann, embedding_dups
from tests.conftest import SF001
from tests.llm.helpers import groups, rows, with_clashes

SCHEMA = "vec_id long, embedding array<float>"
BAD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7),
       (905, [float("inf")] + [1.0] * 7), (906, [0.0, -0.0] * 4)]


def clustered(n, seed, dim=8, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), dim))
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))
    return [[float(np.float32(x)) for x in row] for row in v]


def brute_links(table, bound):
    """Per row: links and the smallest id reached."""
    ok = [k for k, (_, v) in enumerate(table) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, count = [], [0] * len(table)
    for a in range(len(ok)):
        for b in range(a):
            x, y = (np.array(table[ok[k]][1], np.float64) for k in (a, b))
            if len(x) == len(y) and (x.tolist() == y.tolist() or x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= bound):
                links.append((ok[a], ok[b]))
                count[ok[a]] += 1
                count[ok[b]] += 1
    group = groups(links, len(table))
    low = {}
    for (i, _), g in zip(table, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, n, low.get(g), i is not None and i == low.get(g)) for (i, _), n, g in zip(table, count, group)]


def test_threshold_and_collisions():
    rng = np.random.default_rng(0)
    least = embedding_dups.collision_threshold(0.9, 32, 0.6, 0.999)
    assert 0 < least < 32
    p = rng.standard_normal((40, 5))
    got = embedding_dups.collisions(p[:7], p, 0.5)
    want = (np.abs(p[:7, None, :] - p[None, :, :]) <= 0.5).sum(2)
    assert (got == want).all()
    # pairs at the bound pass as often as promised
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(0.19) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    d = embedding_dups.directions(64, 32)
    assert ((np.abs(a @ d - b @ d) <= 0.6).sum(1) >= least).mean() > 0.99


@pytest.mark.parametrize("list_rows,chunk_rows", [(4096, 2048), (4096, 40), (25, 16)])
def test_links_match_brute_force(spark, list_rows, chunk_rows):
    v = clustered(240, 3)
    table = [(i * 2, x) for i, x in enumerate(v)] + [(1, v[0]), (1, v[0]), (77, v[5]), (None, v[6]), (None, [5.0] * 8)]
    table += BAD + [(950, [1.0, 2.0]), (951, [1.0, 2.1]), (952, [2.0, 4.0])]
    df = with_clashes(spark.createDataFrame(table, SCHEMA).repartition(3), "label", "node", "root", "fine", "low", "a")
    got = embedding_dups.near_duplicates(df, 0.9, list_rows=list_rows, chunk_rows=chunk_rows)
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(brute_links(table, 0.9), key=repr)


def test_links_of_low_rank_vectors_over_many_lists(spark):
    # true pairs differ in the few directions in which the centres differ as well
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((8000, 8)) @ rng.standard_normal((8, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], SCHEMA).repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_dups.near_duplicates(df, 0.9, list_rows=160).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = (w @ w.T >= 0.9).sum(1) - 1
    assert want.sum() > 20_000 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.999 * want.sum()


@pytest.mark.parametrize("n", [5, 300])
def test_small_inputs_are_dealt_into_calibrated_lists_as_well(spark, monkeypatch, n):
    seen = []
    calibrated = embedding_dups.calibrated_spread
    monkeypatch.setattr(embedding_dups, "calibrated_spread", lambda classes, sample, centres, *a: seen.append(
        (len(sample), len(centres))) or calibrated(classes, sample, centres, *a))
    table = list(enumerate(clustered(n, 9)))
    got = embedding_dups.near_duplicates(spark.createDataFrame(table, SCHEMA), 0.9)
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(brute_links(table, 0.9), key=repr)
    assert seen == [(n, min(n, embedding_dups.LEAST_CENTRES))]


def test_given_embeddings(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    got = embedding_dups.near_duplicates(df)
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(brute_links(table, 0.9), key=repr)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dups.near_duplicates(empty).count() == 0
    assert ann.search(empty, F.col("vec_id") % 2 == 0).count() == 0
    bad = spark.createDataFrame(BAD, SCHEMA)
    assert embedding_dups.near_duplicates(bad).where("n_links = 0 and kept").count() == len(BAD)
    assert ann.search(bad, F.lit(True)).count() == 0


def brute_nearest(table, asks, k):
    ok = [(i, np.array(v, np.float64)) for i, v in table
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sorted(ok, key=lambda r: (r[0], r[1].tolist())):
        if asks(i) and i not in out:
            best = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)[:k]
            out[i] = [(j, s) for s, j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def recall(got, want):
    hit = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in best}) for i, best in want.items())
    return hit / sum(map(len, want.values()))


def test_search_small_table_is_exact(spark):
    v = clustered(60, 8)
    table = [(i, x) for i, x in enumerate(v)] + [(200, v[0]), (200, v[0]), (300, v[0]), (None, v[1])] + BAD
    df = with_clashes(spark.createDataFrame(table, SCHEMA).repartition(3), "list", "chunk", "probes", "query", "_n")
    got = found(ann.search(df, F.col("vec_id") % 10 == 0, k=5, chunk_rows=20))
    want = brute_nearest(table, lambda i: i % 10 == 0, 5)
    assert {i: [j for j, _ in b] for i, b in got.items()} == {i: [j for j, _ in b] for i, b in want.items()}
    assert all(abs(s - t) < 1e-12 for i in want for (_, s), (_, t) in zip(got[i], want[i]))
    few = spark.createDataFrame(table[:4], SCHEMA)
    assert {i: len(b) for i, b in found(ann.search(few, F.lit(True))).items()} == {i: 3 for i in range(4)}


def test_search_over_lists_has_recall(spark):
    table = [(i, x) for i, x in enumerate(clustered(3000, 2, dim=24, spread=0.6))]
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = found(ann.search(df, F.col("vec_id") % 50 == 0, k=10, list_rows=100, chunk_rows=64))
    assert recall(got, brute_nearest(table, lambda i: i % 50 == 0, 10)) >= 0.95


def test_search_of_given_embeddings(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(ann.search(df, F.col("vec_id") % 10 == 0))
    assert recall(got, brute_nearest(table, lambda i: i % 10 == 0, 10)) >= 0.95


def test_scan_abandons_without_loss():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((2000, 64))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    missed = 0
    for q in rng.standard_normal((50, 64)):
        left = ann.scan(q @ turn, base @ turn, 10)
        best = np.argsort(((base - q) ** 2).sum(1))[:10]
        missed += len(set(best.tolist()) - set(left.tolist()))
        assert len(left) < 800
    assert missed <= 10


def test_search_with_parted_queries_and_a_repeated_row(spark):
    """Queries of a list in parts of three, chunks of eight; a third of the rows is one vector."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((200, 24)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(200)] + [(1000, v[7].tolist())] * 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 4 == 0, k=5, list_rows=50, recall=1.0, chunk_rows=8, part_rows=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    ids, base = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    assert set(got) == {i for i in range(0, 200, 4)} | {1000}
    for q, found in got.items():
        d = np.sqrt(((base - base[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        other = np.flatnonzero(ids != q)
        best = other[np.lexsort((ids[other], d[other]))[:5]]
        assert [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]
        assert [x[2] for x in sorted(found)] == ids[best].tolist()
        assert np.allclose([x[1] for x in sorted(found)], d[best], rtol=1e-12, atol=0)
