"""Helpers for operators that run per grouping key (or over one ledger)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import qcol
from tallyframe.session import staged_table


def qname(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row of per-key aggregates to every row of ``df``.

    Keyed: a null-safe equi-join on the keys. Catalyst/AQE pick the strategy at
    run time — a broadcast when the measured stats side is small, otherwise a
    shuffle join whose hot keys AQE splits. Without keys the stats are a single
    row, attached as a scalar subquery (computed once, inlined as a value), so
    no join and no single-partition exchange of ``df`` exists.
    """
    keys = list(keys)
    cols = [c for c in stats.columns if c not in keys]
    if not keys:
        packed = stats.select(F.struct(*cols).alias("__s")).scalar()
        return df.withColumn("__s", packed).select(
            *[qcol(c) for c in df.columns], *[F.col("__s").getField(c).alias(c) for c in cols])
    renamed = stats.select(*[F.col(k).alias("__k_" + k) for k in keys], *cols)
    cond = [df[k].eqNullSafe(renamed["__k_" + k]) for k in keys]
    joined = df.join(renamed, cond, "left")
    return joined.select(*[df[qname(c)] for c in df.columns], *[renamed[qname(c)] for c in cols])


def top_k(df: DataFrame, keys: Sequence[str], order: list[Column], k: int | None,
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key by ``order`` with a 1-based ``rank`` column.

    Keyed: ``row_number`` filtered to k, which Spark plans as a WindowGroupLimit
    (partial top-k before the shuffle). One ledger: ``orderBy().limit(k)`` — a
    distributed TakeOrdered — and the rank is numbered over the k rows only.
    ``k=None`` keeps and ranks every row, numbered by ``numbered``.
    """
    keys = list(keys)
    if k is None:
        return numbered(df, keys, order, rank_col)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
        return ranked.where(F.col(rank_col) <= k)
    limited = df.orderBy(*order).limit(k)
    return limited.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def numbered(df: DataFrame, keys: Sequence[str], order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Every row of ``df`` with its 1-based number within its key by ``order``, however
    many rows a key has: rows are range-partitioned and sorted by key and order, and
    written with their place; the rows of a key in earlier partitions are added from a
    table of one row per partition and key. Nothing is gathered in one task but that
    table's rows of a key (as many as it has partitions)."""
    keys = list(keys)
    by = [qcol(k).asc() for k in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = staged_table(placed.withColumn("__part", F.shiftright("__at", 33)), "numbered")
    parts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = attach(placed, parts, [*keys, "__part"])
    return out.withColumn(rank_col, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop(
        "__at", "__part", "__first", "__before")
