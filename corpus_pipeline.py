"""Corpus pipeline: reject low quality, keep one of each group of near copies, redact secrets, pack.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``; each
result is written and read again before the next stage starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.functions.settling import settle
from pathclear.llm import jaccard, packing, quality, secrets


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, does not reject.

    Null and empty texts have a score like any other; rows that repeat or tie stay or go together. No documents,
    no result; without labels nothing is rejected. Other columns stay as they are.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies.

    The smallest id stays, of equal ids the smaller hash of the text; rows without an id come before all. Null, empty
    and blank texts are copies of each other; of rows that repeat one stays. An empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced; ``n_chars``, where there is one, follows the text.

    A null text stays null (and so its length), an empty one empty; every row stays, ties and repeats too.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 4096.

    A null or empty text is its end id alone; rows that repeat are packed each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", redacted_documents),
    ("packing", packed_documents),
]
#: Neither the classifier nor tokenization can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
