"""Quotient filters round trip and merge; phrases and scores against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import collocations as c
from tallyframe.llm.quotient_filter import Entries, Shape, decode, encode
from tests.llm.helpers import with_clashes


@pytest.mark.parametrize("k,b", [(2, 1), (2, 20), (2, 32), (3, 17), (3, 32), (4, 16), (5, 1), (5, 13), (5, 21), (5, 32)])
def test_permutation_is_lossless(k, b):
    shape = Shape(k, b)
    assert sum(shape.widths) == k * b and max(shape.widths) <= 64
    rng = np.random.default_rng(k * 100 + b)
    ids = [rng.integers(0, 1 << b, 3000, dtype=np.uint64) for _ in range(k)]
    values = shape.permute(shape.pack(ids))
    assert all((v >> np.uint64(w - 1) >> np.uint64(1) == 0).all() for v, w in zip(values, shape.widths))
    for x, y in zip(ids, shape.unpack(shape.restore(values))):
        assert (x == y).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.integers(1, 32), st.integers(0, 6), st.integers(0, 400), st.randoms())
def test_filters_round_trip_and_merge(k, b, bits, n, random):
    shape = Shape(k, b)
    bits = min(bits, shape.widths[0])
    grams = [tuple(random.randrange(1 << b) for _ in range(k)) for _ in range(max(1, n // 3))]
    shards = defaultdict(list)
    counted = Counter()
    for _ in range(3):
        drawn = random.choices(grams, k=n)
        counted.update(drawn)
        if random.random() < 0.5:
            counted.update(drawn[:1] * 1000)
            drawn = drawn + drawn[:1] * 1000
        columns = shape.permute(shape.pack([np.array([g[j] for g in drawn], np.uint64) for j in range(k)]))
        for shard, own in Entries.of(columns).shards(shape, bits):
            shards[shard].append(encode(own, shape, bits))
    got = Counter()
    for shard, raws in shards.items():
        whole = Entries.merged([decode(r, shape, bits, shard) for r in raws])
        for g, a in zip(zip(*(x.tolist() for x in shape.unpack(shape.restore(whole.columns)))), whole.counts.tolist()):
            assert g not in got
            got[g] = a
    assert got == +counted


def plain(rows, min_count, max_words, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        often = {g: a for g, a in own.items() if len(g) > 1 and a >= min_count}
        kept = []
        for g, a in often.items():
            if any(b >= a and len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in often.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]])
                                 for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


TEXTS = [("en", "New York is. New York was, in New york! of the of the of the"), ("en", "new\x0byork NEW york Été of the same of the"),
         ("fr", "de la de la de la, New York new york"), (None, "of the of the"), ("und", "of the"), ("en", None), ("en", ""),
         ("", "x y x y x y x y"), ("en", ".,;:!?\r\n \t"), ("en", "w" * 5000 + " of the"), ("en", "a a a a a a a a a"),
         ("fr", " de   la"), ("en", "of\x00the of\x00the q of\x00the q")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")


SMALL = {"part_words": 2, "held": 7, "shard_bytes": 8, "deal_bits": 1}


@pytest.mark.parametrize("min_count,how", [(2, {}), (1, SMALL), (3, SMALL)])
def test_phrases_match_plain_counting(spark, min_count, how):
    df = with_clashes(frame(spark, TEXTS * 2).repartition(3), "h", "ids", "shard", "n", "a", "word")
    got = sorted(map(tuple, c.collocations(df, min_count, 5, 40, **how).collect()))
    assert got == plain(TEXTS * 2, min_count, 5, 40)


def test_empty_tables_and_no_frequent_phrase(spark):
    assert c.collocations(frame(spark, [])).count() == 0
    assert c.collocations(frame(spark, TEXTS)).count() == 0
    assert c.collocations(frame(spark, [("en", "one two")] * 3), min_count=3, max_words=2).count() == 1


def test_exact_beyond_64_bits(spark):
    rows = [("en", "a b")] * 3
    got = c.collocations(frame(spark, rows), 2).select("a", "l", "r", "n", "score").first()
    assert tuple(got) == (3, 3, 3, 6, 2000)
    wide = spark.sql("select cast(1000 as decimal(38,0)) * cast(9000000000001 as decimal(38,0)) * cast(10000000000007 as decimal(38,0)) "
                     "div (cast(9000000000002 as decimal(38,0)) * cast(9000000000003 as decimal(38,0)))").first()[0]
    assert wide == 1000 * 9000000000001 * 10000000000007 // (9000000000002 * 9000000000003)
