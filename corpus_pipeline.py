"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Every stage reads all rows that the one before it kept and, but for the last, returns the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm.common import documents, stored
from maskloom.llm.minhash import one_of_each
from maskloom.llm.mixing import mix_rows
from maskloom.llm.packing import pack
from maskloom.llm.pii import sanitise
from maskloom.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted to the labels does not call toxic.

    Every row is judged by its whole text alone, repeated ones alike; null and empty texts are
    scored as texts without words. Rows and columns, null ids and other columns of any name
    included, are passed on as they are. An empty table gives an empty one.
    """
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Null and blank texts are like no other and stay. Rows equal in every column count once, and rows
    of the same id and text whose other columns differ all stay. A null id is never the smallest; in
    a group of null ids alone all stay.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it replaced.

    Only the text changes. Null texts stay null, and repeated rows, null ids and columns of any name
    stay as they are.
    """
    return sanitise(docs, everywhere=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: documents repeated for epochs, or left out.

    Texts without a word have no size and are left out. A null source is a source of its own, the
    last; rows without a label get the plain weight. Rows that share id and text are taken alike.
    """
    return mix_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids.

    Null and empty texts are the end id alone; null ids and repeated rows are documents of their own.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Trained scores and tokenizer ids are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs)
    return docs
