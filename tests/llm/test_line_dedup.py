import hashlib
import random
from collections import Counter

from tallyframe.llm import line_dedup
from tests.llm.helpers import docs, rows, with_clashes

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(table, min_docs, min_chars=1):
    held = Counter()
    for _, text in table:
        held.update({key(x) for x in (text or "").split("\n")})
    hot = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, text in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(),
                    "\n".join(kept)))
    return out


def sample():
    rnd = random.Random(3)
    pool = ["Home", " home\t", "HOME\r", "é", "É", "ok", "\u00a0", "a b", "x" * 50_000, "", " "]
    table = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 6)) + [f"line {rnd.randint(0, 60)}"])) for i in range(60)]
    return table + [(None, None), (None, "Home"), (7, ""), (8, "\n\n"), (9, table[0][1]), (9, table[0][1]), (9, "ok\nz")]


def test_matches_brute_force(spark):
    table = sample()
    for batches, fanout, min_docs in ((1, 4, 10), (6, 2, 10), (3, 2, 2)):
        df = docs(spark, table).repartition(3)
        got = rows(line_dedup.clean(df, min_docs=min_docs, batches=batches, fanout=fanout, digest=True),
                   "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert got == sorted((r[:4] for r in brute(table, min_docs)), key=repr)


def test_texts_and_clashing_columns(spark):
    table = sample()
    df = with_clashes(docs(spark, table), "row", "_row", "h1", "batch", "docs", "n_lines")
    got = line_dedup.clean(df, min_docs=5, min_chars=2)
    assert got.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    want = brute(table, 5, 2)
    assert Counter(r.text or "" for r in got.collect()) == Counter(r[4] for r in want)
    # null stays null where nothing is dropped
    assert got.where("text is null").count() == 1


def test_empty_table(spark):
    assert line_dedup.clean(docs(spark, []), digest=True).count() == 0


def test_levels(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(1, 1), (n + 10, 2)], "h1 long, h2 long"))
    # five runs in pairs: 5 = 4 + 1
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r)[:2] for r in runs.repeated().collect()] == [(1, 1)]
    runs.compact(everything=True)
    assert sum(map(len, runs.levels)) == 1 and runs.repeated().count() == 1
