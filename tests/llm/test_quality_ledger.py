"""The rule ledger against plain Python, policies, ablations and awkward texts."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import quality_ledger as q
from tallyframe.llm.words import steps
from tests.llm.helpers import docs, rows, with_clashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + d for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for d in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_alpha_words": sum(any(c.isalpha() for c in w) for w in words),
            "n_shout_words": sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words),
            "n_bullet_lines": sum(bool(re.match("[\x20\x09-\x0d]*[-*•]", x)) for x in lines),
            "n_ellipsis_lines": sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*$", x)) for x in lines)}


AWKWARD = [None, "", " \t\n\r\x0b\x0c", "a", "a " * 40, "one two three four five six seven eight " * 3, "\n\n- x\n- x\n• y...\nz … ",
           " no break   ", "ÉTÉ HELLO hello H3", "# $ % & | < > *", "x" * 100_000, "\x00 a\x00b \x1c c", "l\n" * 5000,
           " ".join(str(i) for i in range(30)), "a b c d e f g h x a b c d e f g h", "line\nline \nline"]


def test_measures_match_plain_python():
    for _, texts in steps(pa.array(AWKWARD, pa.string()), 1000):
        found = q.measure(texts)
        for k, text in enumerate(texts.to_pylist()):
            assert {m: int(found[m][k]) for m in q.MEASURES} == plain(text), text[:50]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tA#.-é…", max_size=80), min_size=1, max_size=8))
def test_measures_of_random_texts(texts):
    for _, part in steps(pa.array(texts, pa.string())):
        found = q.measure(part)
        for k, text in enumerate(part.to_pylist()):
            assert {m: int(found[m][k]) for m in q.MEASURES} == plain(text)


def test_ledger(spark):
    given = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "a"), (3, "a"), (None, "no id")]
    df = with_clashes(docs(spark, given), "n_words", "failures", "kept", "__text")
    entries = q.ledger(df.repartition(3))
    want = []
    for i, t in given:
        m = plain(t)
        bits = sum(1 << b for b, (_, c) in enumerate(q.RULES) if eval(c, {}, m))  # noqa: S307 - own conditions
        want.append((i, *(m[x] for x in q.MEASURES), bits))
    assert rows(entries, "doc_id", *q.MEASURES, "failures") == sorted(want, key=repr)
    judged = q.judge(entries, q.policy("web"))
    web = q.mask(q.policy("web").rules)
    assert rows(judged, "doc_id", "kept") == sorted(((w[0], w[-1] & web == 0) for w in want), key=repr)
    assert q.ledger(docs(spark, [])).count() == 0 and q.ablation(q.ledger(docs(spark, []))).count() == 0


def test_ablation_matches_judging_anew(spark):
    given = [(i, t) for i, t in enumerate(AWKWARD * 3)]
    entries = q.ledger(docs(spark, given)).cache()
    got = {(r.policy, r.version, r.rule): r for r in q.ablation(entries).collect()}
    assert len(got) == sum(len(p.rules) for p in q.POLICIES)
    all_bits = [(r.failures, r.n_words) for r in entries.collect()]
    for p in q.POLICIES:
        for rule in p.rules:
            m, bit, r = q.mask(p.rules), q.mask([rule]), got[p.name, p.version, rule]
            assert (r.documents, r.kept) == (len(all_bits), sum(b & m == 0 for b, _ in all_bits))
            assert r.failing == sum(b & bit != 0 for b, _ in all_bits)
            assert r.alone == sum(b & m == bit for b, _ in all_bits)
            assert r.kept_without == q.judge(entries, q.Policy("x", 1, [x for x in p.rules if x != rule])).where("kept").count()
            assert r.words_alone == sum(n for b, n in all_bits if b & m == bit)


def test_policies_are_versioned():
    assert q.policy("web").version == 2 and q.policy("web", 1).rules != q.policy("web").rules
    with pytest.raises(ValueError):
        q.policy("web", 9)


def test_an_old_ledger_is_extended_from_its_measurements(spark):
    entries = q.ledger(docs(spark, [(i, t) for i, t in enumerate(AWKWARD)]))
    old = entries.withColumn("failures", F.col("failures").bitwiseAND(0b111)).withColumn("n_rules", F.lit(3))
    assert rows(q.extend(old, 3), "doc_id", "failures", "n_rules") == rows(entries, "doc_id", "failures", "n_rules")
