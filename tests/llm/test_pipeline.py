import re

import corpus_pipeline
from tallyframe.llm import line_dedup, packing, queries
from tallyframe.llm.common import tokenizer_path
from tests.conftest import SF001, SF01
from tests.llm.helpers import docs
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tests.llm.test_tokens import check_packing

import numpy as np


def test_stages_against_brute_force(spark, tmp_path):
    docs_in = spark.read.parquet(f"{SF01}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "pii", "packing"]
    results = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_in, SF01)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        results.append((docs_in.collect(), out.collect()))
        docs_in = out
    (before, after) = results[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    marked = [i for i in labels if labels[i] == 1]
    # few labels to learn from here; the accuracy on larger tables is in the README
    assert len(marked) > 30 and sum(i in gone for i in marked) >= 0.6 * len(marked)
    assert sum(labels.get(i) == 0 for i in gone) <= 0.01 * len(labels)
    before, after = results[1]
    want = {r[0]: r[4] for r in brute_lines([(r.doc_id, r.text) for r in before], 10)}
    assert {r.doc_id: r.text or "" for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    before, after = results[2]
    fp = [brute_fingerprint(r.text) for r in before]
    distinct = np.unique(np.array(fp, np.uint64))
    group = dict(zip(distinct.tolist(), brute_groups(distinct, 3)))
    low = {}
    for r, f in zip(before, fp):
        low[group[f]] = min(low.get(group[f], r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(low.values())
    before, after = results[3]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any(re.search(r"@mail\d\.example\.com", r.text or "") for r in after)
    check_packing(results[4][1], [(r.doc_id, r.text) for r in after], 2048)


def test_stages_on_empty_and_odd_tables(spark):
    rows = [(None, None), (None, ""), (1, "a@b.example.com text"), (1, "a@b.example.com text"), (2, "x " * 50_000)]
    for table in ([], rows):
        df = docs(spark, table)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF001)
            if name == "packing":
                assert len({p.doc_id for p in out.collect()}) == len({r[0] for r in table})
                continue
            assert out.columns == corpus_pipeline.COLUMNS
            n = out.count()
            assert n == len(table) if name != "simhash_near_dedup" else n <= len(table)


def test_registered_queries():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert line_dedup.MIN_DOCS == 10 and packing.SEQUENCE == 2048 and tokenizer_path("byte_bpe_50k.json")
