"""Incremental feeds as file-source streams.

A store is parquet partitioned by month. A batch rewrites only the months it touches
(dynamic partition overwrite: staged, then moved), so the cost of an update follows the
batch and not the history. Every row carries the batch that wrote it; price adjustments are
kept as a small log and applied on read, so a corporate action never rewrites history.
Batches are idempotent: a replay after a lost driver gives the same table. The checkpointed
file source is the ledger of what was already taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalar import utc_day
from ..operators.reconcile import adjustment_verdicts, combine_first, degraded
from ..session import durable
from ..sources.text import newest_per_key


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


class MonthlyStore:
    """Rows with a ``date``, kept by month under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def raw(self) -> DataFrame | None:
        return _read(self.spark, f"{self.root}/data")

    def adjustments(self) -> DataFrame | None:
        return _read(self.spark, f"{self.root}/adjustments")

    def read(self) -> DataFrame | None:
        """Rows as of now: closes times every factor logged after the row was written."""
        rows = self.raw()
        log = self.adjustments()
        if rows is None or log is None or "close" not in rows.columns:
            return rows
        per_entity = log.groupBy("entity").agg(F.collect_list(F.struct("seq", "factor")).alias("__adj"))
        later = F.filter("__adj", lambda a: a["seq"] > F.col("seq"))
        factor = F.aggregate(later, F.lit(1.0), lambda acc, a: acc * a["factor"])
        return rows.join(per_entity, "entity", "left").withColumn(
            "close", F.when(F.col("__adj").isNull(), F.col("close")).otherwise(F.col("close") * factor)
        ).drop("__adj")

    def touched(self, batch: DataFrame, rows: DataFrame) -> DataFrame:
        """Stored rows of the months a batch falls in; the month list prunes the scan."""
        months = batch.select(F.trunc("date", "month").cast("string").alias("month")).distinct()
        return rows.withColumn("month", F.col("month").cast("string")).join(F.broadcast(months), "month", "left_semi")

    def write_months(self, rows: DataFrame, seq: int) -> None:
        out = rows.withColumn("seq", F.lit(seq).cast("long")).withColumn("month", F.trunc("date", "month").cast("string"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.root}/data")

    def log_adjustments(self, factors: DataFrame, seq: int) -> None:
        factors.select("entity", "factor", F.lit(seq).cast("long").alias("seq")).write.mode("overwrite").parquet(
            f"{self.root}/adjustments/batch={seq}"
        )

    def has_adjustments(self, seq: int) -> bool:
        return _read(self.spark, f"{self.root}/adjustments/batch={seq}") is not None

    def _log(self, name: str, rows: DataFrame, seq: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={seq}")

    def _logged(self, name: str, before: int | None = None) -> DataFrame | None:
        log = _read(self.spark, f"{self.root}/{name}")
        return log if log is None or before is None else log.where(F.col("batch") < before)

    def entities(self, before: int | None = None) -> DataFrame | None:
        """(entity, first): what the store knows and its first day, from a small log beside the data."""
        log = self._logged("entities", before)
        if log is None:
            log = self.raw()  # a store without the log
            if log is None:
                return None
            log = (log if before is None else log.where(F.col("seq") < before)).select("entity", F.col("date").alias("first"))
        return log.groupBy("entity").agg(F.min("first").alias("first"))

    def log_entities(self, rows: DataFrame, known: DataFrame | None, seq: int) -> None:
        """New entities, and those whose history now starts earlier."""
        first = rows.groupBy("entity").agg(F.min("date").alias("first"))
        if known is not None:
            old = known.select("entity", F.col("first").alias("__first"))
            first = first.join(old, "entity", "left").where(F.col("__first").isNull() | (F.col("first") < F.col("__first"))).drop("__first")
        self._log("entities", first, seq)

    def verdicts(self, before: int | None = None) -> DataFrame | None:
        """(entity, med, verdict, batch) of every top-up."""
        return self._logged("verdicts", before)

    def pending(self, before: int | None = None) -> DataFrame | None:
        """Fresh rows of entities whose history must be loaded whole before it is trusted."""
        return self._logged("pending", before)

    def waiting(self, before: int) -> DataFrame | None:
        """Entities with pending rows that no whole history has replaced since."""
        held, done = self._logged("pending", before), self._logged("reloaded", before)
        if held is None:
            return None
        last = held.groupBy("entity").agg(F.max("batch").alias("held"))
        if done is None:
            return last.select("entity")
        back = done.groupBy("entity").agg(F.max("batch").alias("back"))
        return last.join(back, "entity", "left").where(F.col("back").isNull() | (F.col("back") < F.col("held"))).select("entity")


def landing(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, store: MonthlyStore, keys: list[str], arrival: str, checkpoint: str) -> StreamingQuery:
    """Append with key dedupe; the latest arrival wins, whatever batch it came in. Keys include ``date``."""

    def handle(batch: DataFrame, seq: int) -> None:
        if batch.isEmpty():
            return
        stored = store.raw()
        rows = batch
        if stored is not None:
            rows = store.touched(batch, stored).select(*batch.columns).unionByName(batch)
        store.write_months(newest_per_key(rows, keys, arrival), seq)

    return _run(stream, checkpoint, handle)


def _by_arrival(stream: DataFrame) -> DataFrame:
    """Mark rows with their file's time and name, so that the last of repeated rows can be told."""
    try:
        return stream.withColumn("__arrival", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    except AnalysisException:  # no file source
        return stream.withColumn("__arrival", F.lit(0))


def upsert_bars(
    stream: DataFrame, store: MonthlyStore, checkpoint: str, report: Callable[[DataFrame], None] | None = None,
    tolerance: float = 0.005, share: float = 0.5,
) -> StreamingQuery:
    """Top up bars: guard, reconcile, new values win; unknown entities are appended.

    Of rows that repeat (entity, date) in a batch the last file's counts. A degraded window is skipped and
    the store stays as it was. An entity whose overlap disagrees (``refetch``) keeps its old rows; its new
    ones go to the pending table until a batch starts at or before its first stored day: that is its whole history
    and replaces what is stored. Verdicts are logged beside the data; ``report`` receives them too. Work follows the
    batch: known entities are a small log, and only touched months are read."""
    cols = ["entity", "date", "close", "volume"]

    def handle(batch: DataFrame, seq: int) -> None:
        if batch.isEmpty():
            return
        new = durable(newest_per_key(batch.select(*cols, "__arrival"), ["entity", "date"], "__arrival").select(*cols))
        known = store.entities(seq)
        if known is None or known.isEmpty():
            store.write_months(new, seq)
            store.log_entities(new, None, seq)
            return
        if degraded(new, known, share).first()["degraded"]:
            return
        said = store.verdicts()
        if said is None or said.where(F.col("batch") == seq).isEmpty():  # a replay keeps the verdicts of the first attempt
            verdicts = durable(adjustment_verdicts(store.touched(new, store.read()).where(F.col("seq") < seq), new, tolerance))
            store.log_adjustments(verdicts.where(F.col("verdict") == "rescale").select("entity", F.col("med").alias("factor")), seq)
            store._log("verdicts", verdicts, seq)
            if report:
                report(verdicts)
        said = store.verdicts().where(F.col("batch") == seq)
        doubted = said.where(F.col("verdict") == "refetch").select("entity")
        if (waiting := store.waiting(seq)) is not None:
            doubted = doubted.unionByName(waiting).distinct()
        starts = new.groupBy("entity").agg(F.min("date").alias("__start")).join(known, "entity")
        whole = durable(doubted.join(starts.where(F.col("__start") <= F.col("first")), "entity").select("entity"))
        held = doubted.join(whole, "entity", "left_anti")
        store._log("pending", new.join(held, "entity", "left_semi"), seq)
        take = durable(new.join(held, "entity", "left_anti"))
        months = take.select("date")
        if not whole.isEmpty():  # also months of the old history that the new one does not have
            months = months.unionByName(store.raw().join(whole, "entity", "left_semi").select("date"))
        old = store.touched(months, store.read()).join(whole, "entity", "left_anti")
        store.write_months(combine_first(take, old), seq)
        store._log("reloaded", whole, seq)
        store.log_entities(take, known, seq)

    return _run(_by_arrival(stream), checkpoint, handle)


def daily_flow(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Buys and sells per entity and day with a watermark; on a closed input this is the batch answer.

    State is bounded by ``late``: rows that come later still are dropped. Where they must count, use ``add_flow``."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), F.col("user_id").alias("entity"))
    return w.agg(*_buys_and_sells()).select("entity", utc_day("window.start").alias("date"), "buy_shares", "sell_shares")


def _buys_and_sells() -> list:
    return [
        F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)).alias(name)
        for kind, name in (("purchase", "buy_shares"), ("error", "sell_shares"))
    ]


def add_flow(events: DataFrame, root: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Buys and sells per entity and day without a watermark: each batch writes its own sums, so a row counts however late it
    comes, and a replayed batch replaces what it wrote. ``added_flow`` adds the batches up."""

    def handle(batch: DataFrame, seq: int) -> None:
        days = batch.groupBy(F.col("user_id").alias("entity"), utc_day(ts).alias("date")).agg(*_buys_and_sells())
        days.write.mode("overwrite").parquet(f"{root.rstrip('/')}/sums/batch={seq}")

    return _run(events, checkpoint, handle)


def added_flow(spark: SparkSession, root: str) -> DataFrame:
    sums = spark.read.parquet(f"{root.rstrip('/')}/sums")
    return sums.groupBy("entity", "date").agg(*[F.sum(c).alias(c) for c in ("buy_shares", "sell_shares")])


def publish_flow(flow: DataFrame, store: MonthlyStore, checkpoint: str) -> StreamingQuery:
    """Running totals per entity and day; each update replaces the rows it restates."""

    def handle(batch: DataFrame, seq: int) -> None:
        if batch.isEmpty():
            return
        stored = store.raw()
        rows = batch.withColumn("__seq", F.lit(seq).cast("long"))
        if stored is not None:
            rows = store.touched(batch, stored).select(*batch.columns, F.col("seq").alias("__seq")).unionByName(rows)
        store.write_months(newest_per_key(rows, ["entity", "date"], "__seq").drop("__seq"), seq)

    return (
        flow.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Files already taken, read from the stream's own checkpoint log."""
    raw = spark.read.text(f"{checkpoint}/sources/0").where(F.col("value").startswith("{"))
    return raw.select(F.from_json("value", "path string, batchId long").alias("f")).select("f.path", "f.batchId")
