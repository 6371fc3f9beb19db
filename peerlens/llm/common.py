"""Helpers that several operators of this folder share."""

from __future__ import annotations

import string
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.session import durable  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    Pure ASCII takes the byte-wise ``lower``; only other texts pay for ``translate``."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(t) == F.octet_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def at_places(docs: DataFrame, places: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose place is (``left_semi``) or is not (``left_anti``) among ``places`` (one column).

    A place is where a row stands in its table, so ``docs`` must give its rows in the same order each time, as files do."""
    row = free_name(docs, "row")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(places.toDF(row), row, how).select(*map(quoted, docs.columns))


def number_in_class(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows_per_bucket: int = 1000) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... inside each class, although one class may hold most rows.

    A class is cut into hash buckets of about ``rows_per_bucket`` rows; buckets are numbered by
    themselves and shifted by the counts before them. ``df`` is read three times, so pass a
    written table. Keys must not be null. Rows that agree in ``order`` are numbered in any order."""
    buckets = max(1, -(-df.count() // rows_per_bucket))
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).select(
        *keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        cut.withColumn("__in", F.row_number().over(inside))
        .join(shift, [*keys, "__bucket"])
        .withColumn(out, F.col("__before") + F.col("__in") - 1)
        .drop("__bucket", "__in", "__before")
    )
