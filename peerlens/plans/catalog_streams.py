"""The event table replayed as a stream; each result equals its batch query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import utc_instant
from ..session import shared_dir
from ..streaming import feeds
from . import views as v
from .reference_sql import with_views
from .registry import query


def _events_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    # a glob, because a stream reads folders and patterns
    return feeds.landing(spark, f"{sf}/events*.parquet", schema)


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("streamed_daily_flow", with_views("SELECT entity, date, buy_shares, sell_shares FROM flow", "flow"))
def streamed_daily_flow(spark, sf):
    root = _folder(spark)
    store = feeds.MonthlyStore(spark, f"{root}/table")
    ev = _events_stream(spark, sf).withColumn("ts", utc_instant("ts"))
    q = feeds.publish_flow(feeds.daily_flow(ev), store, f"{root}/log")
    q.awaitTermination()
    d = store.read()
    return d.select("entity", "date", F.round("buy_shares", 6).alias("buy_shares"), F.round("sell_shares", 6).alias("sell_shares"))


@query("streamed_flow_without_watermark", with_views("SELECT entity, date, buy_shares, sell_shares FROM flow", "flow"))
def streamed_flow_without_watermark(spark, sf):
    root = _folder(spark)
    feeds.add_flow(_events_stream(spark, sf).withColumn("ts", utc_instant("ts")), root, f"{root}/log").awaitTermination()
    d = feeds.added_flow(spark, root)
    return d.select("entity", "date", F.round("buy_shares", 6).alias("buy_shares"), F.round("sell_shares", 6).alias("sell_shares"))


@query(
    "streamed_latest_rows",
    "SELECT user_id AS entity, CAST(ts AS DATE) AS date, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1,2",
)
def streamed_latest_rows(spark, sf):
    root = _folder(spark)
    store = feeds.MonthlyStore(spark, f"{root}/table")
    ev = _events_stream(spark, sf).select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "event_type", "event_id")
    feeds.upsert_latest(ev, store, ["entity", "date"], "event_id", f"{root}/log").awaitTermination()
    return store.read().select("entity", "date", "event_type", "event_id")
