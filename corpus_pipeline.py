"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``; the last returns the placed pieces.

Every stage takes null texts as empty and leaves the other columns as they are; an empty table passes through. Rows
that repeat a doc_id are rows of their own until a stage drops them as copies. Rows are matched by their place in the
table, which files keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import blocknames, mixing, nearcopies, packing, quality
from peerlens.session import durable


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of rows that are not held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id."""
    return blocknames.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash, or by 5-word shingle sets of Jaccard similarity 0.8 or more, the row of the smallest doc_id."""
    return nearcopies.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the entropy-balanced mix takes it (0 to 3 times)."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), special=True)


STAGES = [
    ("quality", accept_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A trained classifier and a tokenizer stand between documents and result: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
