"""Dealing buckets out as blocks of bounded size, every pair within a bucket met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_blocks(rows: DataFrame, bucket: list[str], chunk_rows: int, order: str) -> DataFrame:
    """``rows`` with a column ``block`` such that two rows of one bucket share at
    least one block. A bucket of up to ``2 * chunk_rows`` rows is one block; a larger
    one is cut into chunks by a hash of ``order`` (a unique column), and each two
    chunks meet in a block of their own, so a bucket of a third of all rows is spread
    over many tasks. ``alone`` tells that the block is its whole bucket."""
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("_n"))
    large = (sizes.where(F.col("_n") > 2 * chunk_rows)
             .select(*[F.col(c).alias(f"_l_{c}") for c in bucket],
                     F.ceil(F.col("_n") / chunk_rows).cast("int").alias("_chunks")))
    on = F.lit(True)
    for c in bucket:
        on = on & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    cut = (rows.join(large, on, "left").drop(*[f"_l_{c}" for c in bucket])
           .withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), F.col(order)), F.col("_chunks"))))
    # chunk c meets every chunk: blocks (min, max) of the two numbers
    dealt = cut.withColumn("_other", F.explode(F.when(F.col("_chunks").isNull(), F.array(F.lit(0)))
                                               .otherwise(F.expr("sequence(0, _chunks - 1)"))))
    return (dealt.withColumn("block", F.xxhash64(*bucket, F.least("_chunk", "_other"), F.greatest("_chunk", "_other")))
            .withColumn("alone", F.col("_chunks").isNull()).drop("_chunks", "_chunk", "_other"))
