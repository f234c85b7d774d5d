"""A cleaning pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopyq.llm import quality as quality_model
from canopyq.llm import toxicity as toxicity_model
from canopyq.llm.jaccard import one_of_each_class
from canopyq.llm.packing import pack_documents
from canopyq.llm.secrets import labelled_findings, learned_language, redacted, train_forest
from canopyq.plans.storage import delete, shared_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; the model is fitted on labelled documents of the input."""
    model = toxicity_model.train(docs, _labels(spark, sf_dir))
    return toxicity_model.score(docs, model, keep=tuple(docs.columns), where="score < 0.5")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is 0.3 or more."""
    model = quality_model.train(docs, _labels(spark, sf_dir))
    return quality_model.score(docs, model, keep=tuple(docs.columns), where="score >= 0.3")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return one_of_each_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    findings = labelled_findings(spark)
    return redacted(docs, train_forest(findings, language=learned_language(docs, findings)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained models, MinHash and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; intermediate tables go to the shared folder, and each is deleted once the next is written.

    Null texts count as empty and are judged as such. Repeated rows are one document's copies, of which the near-duplicate stage keeps one. An empty table gives an empty result. Columns
    beyond those of documents, with any names, are carried up to the last stage. Documents without a label are judged like others.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
