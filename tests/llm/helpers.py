"""Small document tables with the awkward cases of every operator."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """``rows``: (doc_id, text) pairs or (doc_id, text, source) triples."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(df, *names):
    """``df`` with extra columns whose names the operators use inside."""
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def groups(links, n):
    """Smallest reachable position of each of ``n`` positions."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
