"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, contaminated
documents go, secrets are replaced, and the rest is mixed to target weights."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespan.llm import blob_ledger, decontam, jaccard, mixing, toxicity
from lorespan.llm.common import remove, shared_checkpoints, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return blob_ledger.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", contaminated),
    ("secrets", secrets),
    ("mixing", mixed),
]
#: A trained model and Newton steps are no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents, each one's result kept as Parquet in the shared folder until the next one's is there (the last but one's as long as the application lives)."""
    folder = f"{shared_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
