"""A corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, and what is left is packed.

Each stage takes the session, the documents that the stage before kept, and
the folder of the tables.  All but the last return the columns of documents.

Defined cases, in every stage: further columns are dropped, also those that are
named like a column of documents but for the case of letters; an empty table
gives none; rows with a null id stay; repeated rows and ids are said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ngram_join, packing, substring, toxicity
from quarry.llm.common import shared_dir, stored
from quarry.llm.queries import CATEGORIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever others there are."""
    names = [c if c in COLUMNS and c not in docs.columns[:i] else f"_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the chain, trained on the labelled ones, calls toxic.

    Rows are judged one by one, by their texts: equal texts go or stay together,
    null and empty texts stay unless most of the labelled documents are toxic,
    and without labels all stay.
    """
    docs = plain(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.rejected(docs, toxicity.train(spark, docs, labels, CATEGORIES), "toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of 5-word shingle similarity 0.8 or more.

    Null and empty texts are like no other and stay; of rows that share an id
    and are linked one stays; rows with a null id stay, and do not make others go.
    """
    return ngram_join.component_filter(spark, plain(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words in windows of 13 words that start in an earlier document.

    Texts that lose nothing stay as they are, null and empty ones among them; a
    text that loses all stays as an empty one; rows that share an id take
    nothing from each other; rows with a null id neither lose nor take.
    """
    docs = plain(docs)
    done = substring.dedup(spark, docs)
    lost = F.col("n_removed") > 0
    count = F.when(lost, F.length("kept").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.withColumns({"text": F.when(lost, F.col("kept")).otherwise(F.col("text")), "n_chars": count}).select(COLUMNS)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of the documents that are left; a row for each row, also for null and empty texts, which have length 0."""
    return packing.pack(spark, plain(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_lengths),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = shared_dir(spark, "pipeline")
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(spark, stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs


#: Training, dynamic programming and components leave no SQL of the same rows; the tests compare with a brute-force version.
ORACLE_SQL = None
