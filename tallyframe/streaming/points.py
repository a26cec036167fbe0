"""Incremental period points for ledger files that keep arriving.

``start_points_stream`` watches a folder with Structured Streaming. Each micro-batch
is a static DataFrame inside ``foreachBatch``: it is aggregated once to partial sums
(money in both readings, for every date candidate), written to
``<sink>/batch_id=<n>`` with overwrite — a replayed batch rewrites the same folder, so
the sink is exactly-once with the stream's checkpoint. ``read_points`` adds the
partials up and only then takes the column-wide decisions, so the result is that of
all rows together, however they were split into batches.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyframe.operators import series
from tallyframe.operators.partials import merged, partials, resolve
from tallyframe.roles import Roles
from tallyframe.session import shared_path


def start_points_stream(spark: SparkSession, source_dir: str, schema: StructType | str, roles: Roles,
                        sink_dir: str, keys: Sequence[str] = (), grain: str = "day",
                        week_start: str = "monday", fmt: str = "csv", options: dict | None = None,
                        checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; returns the query (``available_now`` processes what is
    there and stops, otherwise it keeps running)."""
    opts = {"header": "true"} if fmt == "csv" else {}
    opts.update(options or {})
    stream = spark.readStream.format(fmt).schema(schema).options(**opts).load(source_dir)
    roles = roles.existing(stream.columns)
    ckpt = checkpoint_location or shared_path(spark, "streams", os.path.basename(os.path.normpath(sink_dir)))

    def merge(batch: DataFrame, batch_id: int) -> None:
        parts = partials(batch, roles, keys, grain, week_start).where("level <> 'category'")
        parts.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_points(spark: SparkSession, sink_dir: str, roles: Roles, keys: Sequence[str] = ()) -> DataFrame:
    """Current points ``keys…, period, revenue, expenses, profit, amount, rows``;
    ``roles`` as given to the stream."""
    parts = spark.read.parquet(sink_dir).drop("batch_id")
    points = resolve(merged(parts, keys), roles, keys).where("level = 'period' AND period IS NOT NULL")
    return points.select(*keys, "period", *series.SERIES, F.col("transaction_count").alias("rows"))
