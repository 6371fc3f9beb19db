"""Columnar tables, warehouse reads, and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, date: str | None = "date", mode: str = "overwrite", tasks_per_year: int = 8) -> None:
    """Parquet, partitioned by year when there is a date, so date filters prune folders.

    Rows are spread by (year, hash) first: a year is written by up to ``tasks_per_year`` tasks, and has no more files."""
    if date is None:
        df.write.mode(mode).parquet(path)
        return
    d = df.withColumn("year", F.year(date))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(tasks_per_year))
    d.repartition(F.col("year"), salt).write.mode(mode).partitionBy("year").parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines: missing fields kept as null, dates as ISO text, not-finite numbers as null."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            cols.append(finite(f.name).alias(f.name))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_snapshot(df: DataFrame, path: str) -> None:
    """Append membership rows to a CSV store; names with commas are quoted."""
    out = df.select(
        "entity", "company", "sector", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("")).alias("end_date"), F.coalesce("delist_note", F.lit("")).alias("delist_note"),
    )
    out.write.mode("append").option("emptyValue", "").option("escape", '"').csv(path)


def wide_to_long(df: DataFrame, ids: list[str], name: str = "entity", value: str = "close") -> DataFrame:
    """One column per entity to rows, missing cells dropped."""
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot(ids, cols, name, value).where(F.col(value).isNotNull())


def long_to_wide(df: DataFrame, index: str, name: str, value: str, names: list[str], how: str = "last") -> DataFrame:
    """Rows to one column per listed name. ``first``/``last`` go by the value's arrival order column
    ``arrival`` when there is one, else by the value itself, so the answer does not depend on task order."""
    order = F.col("arrival") if "arrival" in df.columns else F.col(value)
    aggs = []
    for n in names:
        mine = F.when(F.col(name) == n, F.col(value))
        rank = F.when((F.col(name) == n) & F.col(value).isNotNull(), order)
        agg = {"sum": F.sum(mine), "last": F.max_by(mine, rank), "first": F.min_by(mine, rank)}[how]
        aggs.append(agg.alias(n))
    return df.groupBy(index).agg(*aggs)


def save_state(df: DataFrame, path: str) -> None:
    """One-row state (who holds the default), replaced whole."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# --- warehouse ------------------------------------------------------------------------


def _jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None) -> DataFrame:
    """One connection unless ``options`` name partitionColumn, lowerBound, upperBound and numPartitions: give them for large tables."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


def delisting_events(spark: SparkSession, url: str, start: str = "2010-01-01", options: Mapping[str, str] | None = None) -> DataFrame:
    """Delisting events with the name valid on the day; both reads push their filters down."""
    events = _jdbc(spark, url, "crsp.msedelist", options)
    names = _jdbc(spark, url, "crsp.stocknames", options)
    return join_names(events, names, start)


def join_names(events: DataFrame, names: DataFrame, start: str) -> DataFrame:
    d = events.where(F.col("dlstdt") >= F.lit(start).cast("date")).select("permno", "dlstdt", "dlstcd", "dlret")
    n = names.select("permno", "ticker", "namedt", "nameenddt")
    return d.join(n, "permno").where(F.col("dlstdt").between(F.col("namedt"), F.col("nameenddt"))).select(
        "permno", "ticker", "dlstdt", "dlstcd", "dlret"
    )


# Column names of the external table.
QUARTERLY_COLUMNS = (
    "gvkey", "tic", "datadate", "rdq", "fyearq", "fqtr", "revtq", "cogsq", "niq", "oiadpq", "dpq", "atq", "ltq", "seqq",
    "cheq", "dlttq", "dlcq", "cshoq", "oancfy", "capxy",
)


def quarterly_statements(spark: SparkSession, url: str, start: str = "2010-01-01", options: Mapping[str, str] | None = None) -> DataFrame:
    return standard_quarters(_jdbc(spark, url, "comp.fundq", options), start)


def standard_quarters(raw: DataFrame, start: str) -> DataFrame:
    """Industrial, standardised, domestic, consolidated quarters only."""
    keep = (
        (F.col("indfmt") == "INDL") & (F.col("datafmt") == "STD") & (F.col("popsrc") == "D") & (F.col("consol") == "C")
        & (F.col("datadate") >= F.lit(start).cast("date"))
    )
    return raw.where(keep).select(*QUARTERLY_COLUMNS)
