"""JSON documents as tables: split-orient frames, nested filing facts, column-array filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, reaction_day

SPLIT_SCHEMA = "struct<columns:array<string>,index:array<string>,data:array<array<double>>>"
FACT = "struct<start:string,end:string,val:double,filed:string,fy:int>"
FACTS_SCHEMA = f"map<string,map<string,struct<units:map<string,array<{FACT}>>>>>"
FILINGS_SCHEMA = (
    "struct<form:array<string>,items:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>>"
)
# Unit preference, best first.
UNIT_ORDER = ("USD", "shares", "USD/shares", "pure")


def split_frame(df: DataFrame, doc: str, keys=("entity",)) -> DataFrame:
    """{columns, index, data} documents to (keys, name, column, value); '{}' or NULL give no rows."""
    d = df.select(*keys, F.from_json(doc, SPLIT_SCHEMA).alias("d")).where(F.col("d.data").isNotNull())
    rows = d.select(*keys, "d.columns", F.explode(F.arrays_zip(F.col("d.index").alias("name"), F.col("d.data").alias("vals"))).alias("r"))
    cells = rows.select(
        *keys, F.col("r")["name"].alias("name"),
        F.explode(F.arrays_zip(F.col("columns").alias("column"), F.col("r")["vals"].alias("value"))).alias("c"),
    )
    return cells.select(*keys, "name", F.col("c")["column"].alias("column"), F.col("c")["value"].alias("value"))


def to_split_frame(cells: DataFrame, keys=("entity",)) -> DataFrame:
    """The inverse: (keys, name, column, value) to one document per key. A document is one entity's
    statement, a few dozen cells."""
    per_row = cells.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("column", "value"))).alias("__c"))
    doc = per_row.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "__c"))).alias("__r"))
    body = F.struct(
        F.transform(F.col("__r")[0]["__c"], lambda c: c["column"]).alias("columns"),
        F.transform("__r", lambda r: r["name"]).alias("index"),
        F.transform("__r", lambda r: F.transform(r["__c"], lambda c: c["value"])).alias("data"),
    )
    return doc.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


def filing_facts(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Nested taxonomy -> tag -> units documents to fact rows, one preferred unit per tag."""
    f = df.select("entity", F.from_json(doc, FACTS_SCHEMA).alias("d"))
    tags = f.select("entity", F.explode("d").alias("taxonomy", "tags")).select(
        "entity", "taxonomy", F.explode("tags").alias("tag", "node")
    )
    units = F.col("node.units")
    unit = F.coalesce(*[F.when(F.map_contains_key(units, u), F.lit(u)) for u in UNIT_ORDER], F.map_keys(units)[0])
    picked = tags.where(F.size(units) > 0).withColumn("unit", unit)
    rows = picked.select("entity", "taxonomy", "tag", "unit", F.explode(F.col("node.units")[F.col("unit")]).alias("e"))
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(f"e.{c}"), F.lit("yyyy-MM-dd")))
    return rows.select(
        "entity", "taxonomy", "tag", "unit", day("start").alias("start"), day("end").alias("end"),
        finite("e.val").alias("val"), day("filed").alias("filed"), F.col("e.fy").alias("fy"),
    )


def earnings_filings(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Column-array filings to (entity, filed, accepted) of results announcements."""
    d = df.select("entity", F.from_json(doc, FILINGS_SCHEMA).alias("d"))
    rows = d.select(
        "entity", F.explode(F.arrays_zip("d.form", "d.items", "d.filingDate", "d.acceptanceDateTime")).alias("r")
    ).select("entity", "r.*")
    hit = (F.col("form") == "8-K") & F.coalesce(F.contains("items", F.lit("2.02")), F.lit(False))
    return rows.where(hit).select("entity", F.col("filingDate").alias("filed"), F.coalesce("acceptanceDateTime", F.lit("")).alias("accepted"))


def earnings_events(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Filings to distinct (entity, reaction_date)."""
    e = earnings_filings(df, doc)
    return e.select("entity", reaction_day("filed", "accepted").alias("reaction_date")).where(
        F.col("reaction_date").isNotNull()
    ).distinct()
