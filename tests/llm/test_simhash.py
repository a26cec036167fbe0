import random

import numpy as np
import pytest
import xxhash

from tallyframe.llm import simhash
from tallyframe.llm.components import components
from tests.llm.helpers import docs, groups, rows, with_clashes

SPACE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text, shingle=3):
    for c in SPACE[1:]:
        text = (text or "").replace(c, " ")
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in text.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rng, n, centres, flips):
    fp = rng.integers(0, 2 ** 64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fp ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(fp)


def brute_groups(fp, radius):
    d = np.unpackbits((fp[:, None] ^ fp[None, :]).view(np.uint8).reshape(len(fp), len(fp), 8), axis=2).sum(2)
    return groups(np.argwhere(np.triu(d <= radius, 1)).tolist(), len(fp))


def test_fingerprints():
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "a b c", "A B C", "é É x y", "x y z w", "w " * 70_000]
    texts += [" ".join(rnd.choices(["the", "Cat", "sat", "on", "mat\n", "\x0b"], k=rnd.randint(1, 40))) for _ in range(200)]
    for t in texts:
        for shingle in (1, 3):
            assert simhash.fingerprint(t, shingle) == brute_fingerprint(t, shingle)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 600])
def test_bit_sliced_links(n):
    rng = np.random.default_rng(n)
    for radius in (0, 1, 2, 3, 5):
        fp = near(rng, n, max(1, n // 6), 3)
        links = simhash.bit_sliced_links(fp, radius)
        assert len(links) < max(1, len(fp)) and groups(links, len(fp)) == brute_groups(fp, radius)


def test_links_over_bands_and_chunks(spark):
    rng = np.random.default_rng(9)
    # a dense group of neighbours, random ones, and groups of copies
    fp = np.unique(np.concatenate([near(rng, 400, 1, 3), near(rng, 300, 60, 2), rng.integers(0, 2 ** 64, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    want = brute_groups(fp, 3)
    for bands, chunk in ((4, 2048), (4, 30), (5, 64), (6, 16)):
        links = [(at[r.a], at[r.b]) for r in simhash.links(df, 3, chunk, bands).collect()]
        assert groups(links, len(fp)) == want, (bands, chunk)


def test_band_count():
    assert [simhash.band_count(10 ** k) for k in (2, 5, 9, 13)] == [4, 4, 5, 7]


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)]
    pairs += [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(150)] + [(5, 5), (160, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, 1400)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def table():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=80)) for _ in range(30)]
    out = [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:15]):
        own = t.split(" ")
        own[rnd.randint(0, 79)] = "changed"
        out += [(50 - i, " ".join(own)), (200 + i, t.upper())]
    return out + [(3, None), (2, ""), (9, " \n"), (None, base[0]), (None, None), (100, base[0]), (100, base[0]),
                  (None, "only null ids"), (100, base[1] + " x")]


def test_near_duplicates_match_brute_force(spark):
    rows_in = table()
    df = with_clashes(docs(spark, rows_in).repartition(4), "fp", "rk", "block", "node", "low", "_fp")
    found = simhash.near_duplicates(df, chunk_rows=8)
    fp = [brute_fingerprint(t) for _, t in rows_in]
    distinct = np.unique(np.array(fp, np.uint64))
    group = dict(zip(distinct.tolist(), brute_groups(distinct, 3)))
    low = {}
    for (i, _), f in zip(rows_in, fp):
        if i is not None:
            low[group[f]] = min(low.get(group[f], i), i)
    want = [(i, f - 2 ** 64 if f >= 2 ** 63 else f, low.get(group[f])) for (i, _), f in zip(rows_in, fp)]
    assert rows(found, "doc_id", "fp", "component_id") == sorted(want, key=repr)
    # one row of each group stays, that of the smallest id
    kept = simhash.representatives(df, chunk_rows=8)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted((low.get(g) for g in set(group.values())), key=repr)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.representatives(docs(spark, [])).count() == 0
