import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm import toxicity
from tests.conftest import SF01
from tests.llm.helpers import docs, with_clashes


def brute_segments(scores):
    """Maximal scoring segments by the recursive definition: the best segment (the
    shortest, leftmost), then what lies left and right of it."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out = []

    def split(a, b):
        best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)),
                   default=None)
        if best is None or best[0] <= 0:
            return
        out.append((best[3], best[4], best[0]))
        split(a, best[3])
        split(best[4], b)

    split(0, len(scores))
    return sorted(out)


def test_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 12, 25):
        for _ in range(60):
            s = rng.normal(-0.2, 1, n)
            got = toxicity.segments(s)
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]
            assert all(abs(x - s[a:b].sum()) < 1e-9 for a, b, x in got)


def test_tokens():
    flat, ends = toxicity.tokens(pa.array([None, "", "  Idiot!  idiot\n(IDIOT) ", "é", "\t"]))
    assert np.diff(ends).tolist() == [0, 0, 3, 1, 0] and len(set(flat[:3].tolist())) == 1


def test_extreme_value_rate():
    s, p = np.array([-1.0, 1.0]), np.array([0.7, 0.3])
    assert abs(toxicity.extreme_value_rate(s, p) - np.log(7 / 3)) < 1e-6


def test_held_out_accuracy(spark):
    df, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(df, labels, ~toxicity.held_out())
    got = toxicity.score(df, model, ["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.95
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in got]) > 0.95
    assert any(r.passages for r in got if r.toxic == 1)


def tables(spark, labelled=True):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(300):
        own = rnd.choices(words, k=60)
        if i % 4 == 0:
            own[20:24] = ["vile", "nasty", "vile!", "Nasty"]
        rows.append((i, " ".join(own)))
        marks.append((i, None, int(i % 4 == 0)))
    rows += [(None, None), (None, "vile nasty vile nasty"), (500, ""), (501, "vile " * 30_000), (3, rows[3][1])]
    marks += [(None, 1, 1), (7, None, None), (0, 1, 0), (9999, 1, 1)]
    df = with_clashes(docs(spark, rows).repartition(3), "toxic", "_id", "kind", "calibrates", "passages")
    return df, spark.createDataFrame(marks if labelled else [], "doc_id long, quality int, toxic int")


def test_passages_and_odd_rows(spark):
    df, labels = tables(spark)
    model = toxicity.fit(df, labels, ~toxicity.held_out())
    got = toxicity.score(df.drop("passages"), model, ["doc_id", "text"]).collect()
    assert len(got) == 305
    for r in got:
        toxic = r.doc_id is not None and r.doc_id < 300 and r.doc_id % 4 == 0
        if r.doc_id is not None and r.doc_id < 300:
            assert (r.score >= 0.5) == toxic
            assert [(p.first, p.last) for p in r.passages] == ([(20, 24)] if toxic else [])
    by_text = {r.text if r.text is None else r.text[:10]: r.score for r in got if r.doc_id not in range(300)}
    assert by_text[None] == by_text[""] < 0.5 < by_text["vile nasty"]
    again = toxicity.score(df.drop("passages"), toxicity.fit(df, labels, ~toxicity.held_out()), ["doc_id"])
    assert sorted((r.score for r in again.collect())) == sorted(r.score for r in got)


def test_without_labels_or_rows(spark):
    df, none = tables(spark, labelled=False)
    model = toxicity.fit(df, none, F.lit(True))
    assert {r.score for r in toxicity.score(df, model, ["doc_id"]).collect()} == {0.0}
    empty = docs(spark, [])
    model = toxicity.fit(empty, none, F.lit(True))
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, one, F.lit(True))
    assert {r.score for r in toxicity.score(df, model, ["doc_id"]).collect()} == {0.0}
