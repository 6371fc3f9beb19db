"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of fixed size. The distinct blocks are sorted and numbered, so a block is
known by an integer name. Then adjacent names are paired and the distinct pairs are sorted and
numbered in turn, until one name stands for the whole document. Two documents share (level, name)
exactly when their texts are equal: a name is given per distinct content, never by a hash.

Block texts are shuffled once, after map-side removal of repeats. A SHA-256 digest is only the
address under which a block looks its name up; each address is checked to stand for one text, and
the job stops rather than merge two. Every later level moves pairs of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.llm.common import at_places, durable, fold_ascii, table

BLOCK_CHARS = 4096


def _blocks(text: Column, size: int) -> Column:
    """Cut in one pass over the text; an empty text is one empty block."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names in sort order within each partition; unique over all partitions."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> DataFrame:
    """(address, name) of every distinct block."""
    blocks = texts.select(F.explode(_blocks(F.col("text"), size)).alias("block"))
    distinct = blocks.select(F.unhex(F.sha2("block", 256)).alias("address"), "block").distinct()
    return (
        _named(distinct, ["block"])
        .groupBy("address")
        .agg(F.min("name").alias("name"), F.count("*").alias("texts"))
        .select("address", F.when(F.col("texts") == 1, F.col("name")).otherwise(F.raise_error(F.lit("two blocks share a digest")).cast("long")).alias("name"))
    )


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): one identity per row, equal exactly for equal texts.

    Levels are one more than log2 of the longest document's blocks; each works on the documents
    that still have more than one name and is written before the next reads it."""
    texts = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("text"))
    rows = durable(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block_chars), lambda b: F.unhex(F.sha2(b, 256))).alias("addresses"),
        )
    )
    names = durable(_block_names(texts, block_chars))
    left = rows.select("row", F.size("addresses").alias("n"), F.posexplode("addresses").alias("pos", "address"))
    at = durable(left.join(names, "address").select("row", "n", "pos", "name"))
    longest = rows.agg(F.max(F.size("addresses"))).first()[0] or 1

    found, level = at.where("n = 1").select("row", F.lit(0).alias("level"), "name"), 0
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = durable(
            at.where("n > 1")
            .groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(F.max(F.when(even, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second"))
        )
        named = durable(_named(pairs.select("first", "second").distinct(), ["first", "second"]))
        at = durable(
            pairs.join(named, ["first", "second"]).select(
                "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name"
            )
        )
        found = found.unionByName(at.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    return rows.select("row", "doc_id", "text_sha256").join(found, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the
    largest doc_id stays (null ids come last); of rows that repeat that id, one stays. An empty table
    gives no rows; other columns are ignored. ``row`` is the place of the row in ``docs``."""
    named = durable(document_names(docs, id_col, text_col, block_chars))
    groups = durable(
        named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are matched by their place, so ``docs`` must be a table that gives its rows in the same order
    each time, such as files."""
    return at_places(docs, exact_duplicates(docs).where("kept").select("row"))


def op6_block_naming(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
