"""A training-data pipeline over ``documents``: toxicity, line dedup, SimHash
near-dedup, PII, packing.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows
the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import line_dedup, packing, pii, simhash, toxicity
from tallyframe.llm.common import new_folder, read, tokenizer_path
from tallyframe.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source",
                     F.char_length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones."""
    configure(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go, in every document."""
    configure(spark)
    return _documents(line_dedup.clean(docs, min_docs=10, min_chars=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 3-word shingles, 3 bits."""
    configure(spark)
    return simhash.representatives(docs, shingle=3, radius=3).select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes format-preserving pseudonyms."""
    configure(spark)
    return _documents(pii.pseudonymise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, every source in its share of each window."""
    configure(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, sequence=2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_duplicates),
          ("pii", replace_pii), ("packing", pack)]

#: The toxicity model and the tokenizer are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
