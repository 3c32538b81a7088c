"""A corpus pipeline of five stages: toxicity, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever further columns there are. run() writes
what each returns as Parquet to the shared folder and reads it again for the
next.

In all stages a null text counts as an empty one, which is not toxic, is a near
duplicate of the other empty ones, holds no secret, is never drawn by the mix,
and has no tokens; long texts are read whole; repeated rows are rows of their own
until the near-duplicates go; and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm import bpe, mixing, secrets, simhash, toxicity
from isoline.llm.common import forget, table, unused, written


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half, by a model of these documents' labels."""
    return toxicity.drop_toxic(docs, toxicity.trained_on(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets cut out of their texts."""
    return _sized(secrets.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix draws a document, shard after shard, each shuffled by itself."""
    shard, order = unused(docs, "mix_shard"), unused(docs, "mix_order")
    return mixing.shuffled(mixing.mixed(docs), shard, order).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, as a count and digests of the ids and of the decoded text."""
    return bpe.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: Training, splitting trees and merges have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:  # what the stage before had written is read
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
