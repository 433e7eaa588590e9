"""A cleaning pipeline over ``documents``: each stage reads what its predecessor wrote and writes what it keeps.

1. ``toxicity``: documents with a score of 0.5 or more go.
2. ``near_copies``: of each class of linked documents the one with the smallest id stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``secrets``: secret spans are replaced by a mark in the text; all documents stay.
5. ``pieces``: the texts become SentencePiece ids.

Models are fitted on ``labels`` of ``sf_dir`` and the documents that reach the stage. Rows with null ids or null texts go
through all stages; a null text has no ids at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forecastlab.llm import decontamination, jaccard_groups, secrets, sentence_pieces, toxicity
from forecastlab.llm.common import table
from forecastlab.session import settle


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_groups.keep_one(docs)


def leaking_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_leaking(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("near_copies", near_copies),
    ("decontamination", leaking_documents),
    ("secrets", secret_spans),
    ("pieces", piece_ids),
]
#: The toxicity score has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
