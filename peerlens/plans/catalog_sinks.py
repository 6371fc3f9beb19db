"""Sinks and the bar top-up: the given tables written by the library's writers and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import tables, text
from ..streaming import feeds
from . import views as v
from .reference_sql import with_views
from .registry import query


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


@query(
    "orders_written_by_year",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice, CAST(year(CAST(o_orderdate AS DATE)) AS BIGINT) AS year FROM orders",
)
def orders_written_by_year(spark, sf):
    """Year partitions, written and read back; the year comes from the folder names."""
    out = _folder(spark)
    tables.write_table(v.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"), out)
    return tables.read_table(spark, out).select("o_orderkey", "date", "o_totalprice", F.col("year").cast("long").alias("year"))


@query(
    "membership_snapshot_appended",
    with_views("SELECT CAST(entity AS VARCHAR) AS entity, company || ', Inc' AS company, sector, start_date, end_date FROM membership", "membership"),
)
def membership_snapshot_appended(spark, sf):
    """Open and closed memberships appended to a line store in two batches, then parsed again."""
    out = _folder(spark)
    rows = v.membership(spark, sf).withColumn("entity", F.col("entity").cast("string")).withColumn("company", F.concat("company", F.lit(", Inc")))
    tables.append_snapshot(rows.where("end_date IS NULL"), out)
    tables.append_snapshot(rows.where("end_date IS NOT NULL"), out)
    return text.membership(text.lines(spark, out)).select("entity", "company", "sector", "start_date", "end_date")


@query(
    "records_written_as_lines",
    "SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_retailprice END AS price, DATE '1998-01-01' AS day FROM part",
)
def records_written_as_lines(spark, sf):
    """JSON lines with missing and not-finite numbers as null, read back by schema."""
    out = _folder(spark)
    price = F.when(F.col("p_size") > 25, F.col("p_retailprice")).when(F.col("p_size") > 12, F.lit(float("nan")))
    tables.write_records(v.table(spark, sf, "part").select("p_partkey", "p_brand", price.alias("price"), F.lit("1998-01-01").cast("date").alias("day")), out)
    return spark.read.schema("p_partkey bigint, p_brand string, price double, day date").json(out)


def _replayed(spark, sf):
    """Weekly bars landed in two parts; the second, with a three week overlap, is quoted on half the price and repeats its rows."""
    bars = v.bars_raw(spark, sf).select("entity", "date", "close", "volume")
    src, root = _folder(spark), _folder(spark)
    cut = F.lit("1996-01-01").cast("date")
    schema = bars.schema
    first = bars.where(F.col("date") < cut)
    later = bars.where(F.col("date") >= F.date_sub(cut, 21)).withColumn("close", F.col("close") * 0.5)
    store = feeds.MonthlyStore(spark, f"{root}/table")
    for part in (first, later.unionByName(later)):
        part.write.mode("append").parquet(src)
        feeds.upsert_bars(feeds.landing(spark, src, schema), store, f"{root}/log").awaitTermination()
    return store, f"{root}/log"


@query(
    "streamed_bars_topped_up",
    with_views(
        "SELECT b.entity, b.date, round(CASE WHEN o.n >= 2 OR b.date >= DATE '1996-01-01' - 21 THEN b.close * 0.5 ELSE b.close END, 9) AS close, b.volume "
        "FROM bars b LEFT JOIN (SELECT entity, count(*) AS n FROM bars WHERE date >= DATE '1996-01-01' - 21 AND date < DATE '1996-01-01' GROUP BY 1) o USING (entity)",
        "bars",
    ),
)
def streamed_bars_topped_up(spark, sf):
    """A split between two landings: history is rescaled by the log of adjustments, repeated rows count once."""
    store, _ = _replayed(spark, sf)
    return store.read().select("entity", "date", F.round("close", 9).alias("close"), "volume")


@query(
    "bar_verdicts_logged",
    with_views(
        "SELECT entity, 0.5 AS med, 'rescale' AS verdict FROM bars WHERE date >= DATE '1996-01-01' - 21 AND date < DATE '1996-01-01' GROUP BY 1 HAVING count(*) >= 2",
        "bars",
    ).replace("0.5 AS med", "CAST(0.5 AS DOUBLE) AS med"),
)
def bar_verdicts_logged(spark, sf):
    store, _ = _replayed(spark, sf)
    return store.verdicts().select("entity", F.round("med", 6).alias("med"), "verdict")


@query("landed_files_ledger", "SELECT CAST(b AS BIGINT) AS batch, true AS new_files_only FROM range(2) t(b)")
def landed_files_ledger(spark, sf):
    """The stream's own ledger: two landings were two batches, and no file was taken twice."""
    _, log = _replayed(spark, sf)
    taken = feeds.ledger(spark, log)
    times = taken.groupBy("path").agg(F.count("*").alias("n"), F.min("batchId").alias("batch"))
    return times.groupBy("batch").agg((F.max("n") == 1).alias("new_files_only"))
