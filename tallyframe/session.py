"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. Time zone is pinned so that timestamp_ntz
# values and period boundaries mean the same thing on every executor.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows handed to Python at once: whole texts, so fewer than the default 10,000
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # and at most this many bytes of them, so that long texts do not add up
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 ** 2),
    # the JVM never compiles a method longer than this: such a stage runs operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Reading cp1251 ledgers needs the legacy charset list in Spark 4.x.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of a finished analysis are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyframe") -> SparkSession:
    """Return (or build) a session with the engine's settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the whole cluster (a cluster sizes it at submit)
            builder = builder.config("spark.driver.memory", "8g")
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sizing_conf(input_bytes: int, target_partition_bytes: int = 128 * 1024 ** 2,
                max_partitions: int = 100_000) -> dict[str, str]:
    """Shuffle sizing for a given input volume: enough initial shuffle partitions
    that each holds about ``target_partition_bytes`` before AQE coalesces the
    small ones, and the same size as AQE's advisory and scan split size. For
    100 TB this gives the 100 000 cap (≈1 GB per partition before partial
    aggregation shrinks it); the ledger aggregates here shuffle far less than
    they read."""
    n = max(200, min(max_partitions, input_bytes // target_partition_bytes + 1))
    size = f"{target_partition_bytes // (1024 ** 2)}m"
    return {"spark.sql.shuffle.partitions": str(n),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
            "spark.sql.files.maxPartitionBytes": size,
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the engine relies on to any session
    (time zone, AQE, charsets) and make sure a checkpoint folder is known."""
    apply_settings(spark)
    ensure_checkpoint_dir(spark)
    _ship_code_by_value()
    return spark


def apply_settings(spark: SparkSession) -> None:
    """The engine's runtime SQL settings."""
    for key, value in ENGINE_CONF.items():
        if key.startswith("spark.sql."):
            try:
                spark.conf.set(key, value)
            except Exception:  # noqa: BLE001 - a static conf on a running session
                pass


def _ship_code_by_value() -> None:
    """Pickle this package's functions by value into tasks (applyInPandas /
    mapInPandas), so executors need no installed copy of it. Installing the
    package or ``--py-files`` on a cluster works as well."""
    import sys

    from pyspark import cloudpickle
    pkg = sys.modules[__name__.split(".")[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg)
    except (ValueError, AttributeError):
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; we read it
    from the session and never override it. Only a local master, where driver and
    executors are one machine, gets a fresh folder; elsewhere the setting must be
    there, because other machines would not see a folder of the driver's.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        path = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A location under the shared checkpoint folder (for staged tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tallyframe", *parts)


def staged_table(df: DataFrame, tag: str, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared one and read back (by
    ``spark``, if its own session is another): the lineage is cut, a lost executor costs
    only the tasks that ran on it, and both sides of a later join are tables that AQE can split."""
    spark = spark or df.sparkSession
    path = shared_path(spark, "tables", f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
