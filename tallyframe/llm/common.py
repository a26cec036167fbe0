"""Shared helpers: table reading, staged tables in the shared folder, worker state."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import shared_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return shared_path(spark, "llm", f"{tag}-{uuid.uuid4().hex}")


def staged(df: DataFrame, tag: str, **partition_by) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is
    cut, and a lost executor costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path, **partition_by)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def worker_state(key, make):
    """``make()`` once per Python worker process, as long as the worker asks for the same
    ``key``; another key replaces it, so a reused worker holds the state of one operator
    only. Kept in ``sys.modules`` so that it outlives a task even when this package's
    functions travel pickled by value."""
    kept = sys.modules.setdefault("_tallyframe_worker", types.ModuleType("_tallyframe_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("state", None)
        kept["key"], kept["state"] = key, make()
    return kept["state"]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of 64 bits that equal (id, text) rows share, usable where ids are null or
    repeated. Different rows can collide; join on the id as well."""
    return F.xxhash64(F.col(doc_id), F.lit("|"), F.col(text))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` lies."""
    import public_tokenizers
    return public_tokenizers.path(name)
