"""The corpus pipeline: five stages from raw documents to packed sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as a Parquet table in the shared folder and
gives what it reads back to the next stage. All stages but the last return the columns of documents.

1. language: documents whose language cannot be determined (no letters, or two codewords about as near) go.
2. near_duplicates: of every group of similar texts the document with the least id stays.
3. decontamination: documents that hold a benchmark item within the edit budget go.
4. secrets: found secrets are replaced by a mark in the text.
5. packing: what is left becomes sequences of 2048 tokens.

Defined results: rows with a null, empty or letterless text go in the first stage; texts may be as long as a row can
hold. A doc_id is a whole number and names one text; rows without one are kept by the stages that group by id, and
repeated rows are kept or dropped together, and packed as often as they are there. Of equally good documents the one with
the least id stays. An empty table gives no rows. Extra columns pass through all stages but the last, whatever their names.

ORACLE_SQL is None: SQL can express neither the trained classifier nor the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowparity.llm import decontam, language, packing, secrets, simhash
from rowparity.llm.common import saved, saved_at, scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.train(language.training_rows(docs)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.scan(docs.select(F.col("doc_id").alias("path"), "text")).findings)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences' pieces, as a table; what the stages wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as made:
        for _, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir))
        pieces, path = saved_at(STAGES[-1][1](spark, docs, sf_dir))
        made.remove(path)
    return pieces
