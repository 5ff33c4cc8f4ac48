"""The text pipeline: language, near-duplicates, benchmark passages, personal data, pieces.

Each stage works on all that the stage before it kept, written and read again in between; all but the last return the columns of
documents.  A null text is rejected by the first stage, like any text without letters; extra columns pass through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import common, decontaminate, langid, neardup, pieces, pii
from quantloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: keeps documents whose language the network recognises; `und` and undecided ones go."""
    return langid.kept(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: keeps one document of each group."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: cuts benchmark passages; documents that are mostly such passages go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: masks personal data; keeps every document."""
    return pii.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, n_pieces, pieces, lossless of every document."""
    return pieces.sampled(docs, vocabulary())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("piece_encoding", encoding),
]

#: Stages 1 and 5 cannot be said in SQL; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again, what it read is deleted there."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    top = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{name}")
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
