"""Line-oriented feeds. Each parser takes a frame with a ``value`` column of whole lines, as
``spark.read.text`` gives it, so the same code runs on files, archives or derived lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import market_key
from ..operators.overrides import typed_overrides

OVERRIDE_FIELDS = ("date", "entity", "analyst", "direction", "reason_code", "factor", "note", "expires")
MEMBERSHIP_FIELDS = ("entity", "company", "sector", "start_date", "end_date", "delist_note")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _content(df: DataFrame, header_prefix: str | None = None) -> DataFrame:
    """Lines that are not blank, comments or headers."""
    v = F.trim("value")
    keep = (v != "") & ~v.startswith("#")
    if header_prefix:
        keep = keep & ~F.lower(v).startswith(header_prefix)
    return df.where(keep)


def _csv_fields(value: str = "value"):
    """Split one line on commas outside double quotes; quotes removed, doubled quotes kept once."""
    parts = F.split(F.col(value), r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(
        parts,
        lambda p: F.when(
            p.startswith('"') & p.endswith('"') & (F.length(p) >= 2),
            F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), '""', '"'),
        ).otherwise(p),
    )


def membership(df: DataFrame) -> DataFrame:
    """Membership intervals. Fewer than five fields are skipped; extra commas belong to the
    company name; a missing end date means still a member."""
    f = _content(df, "ticker,").select(_csv_fields().alias("f")).where(F.size("f") >= 5)
    n = F.size("f")
    long = F.concat(
        F.slice("f", 1, 1), F.array(F.array_join(F.slice(F.col("f"), F.lit(2), n - 5), ",")), F.slice(F.col("f"), n - 3, F.lit(4))
    )
    g = f.select(F.when(n > 6, long).when(n == 5, F.concat("f", F.array(F.lit("")))).otherwise(F.col("f")).alias("f"))
    day = lambda i: F.to_date(F.try_to_timestamp(F.nullif(F.trim(F.col("f")[i]), F.lit("")), F.lit("yyyy-MM-dd")))
    return g.select(
        market_key(F.col("f")[0]).alias("entity"), F.col("f")[1].alias("company"), F.col("f")[2].alias("sector"),
        day(3).alias("start_date"), day(4).alias("end_date"), F.col("f")[5].alias("delist_note"),
    ).where(F.col("start_date").isNotNull())


def overrides(df: DataFrame) -> DataFrame:
    """Override log lines (comments allowed) to typed rows with ``valid``."""
    f = _content(df, "date,").select(_csv_fields().alias("f"))
    raw = f.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(OVERRIDE_FIELDS)])
    return typed_overrides(raw)


def holdings(df: DataFrame) -> DataFrame:
    """Holdings lines: entity and an optional note."""
    f = _content(df, "ticker,").select(F.split("value", ",", -1).alias("f"))
    return f.select(
        F.upper(F.trim(F.col("f")[0])).alias("entity"), F.coalesce(F.trim(F.get("f", F.lit(1))), F.lit("")).alias("note")
    ).where(F.col("entity") != "")


def short_volume(df: DataFrame) -> DataFrame:
    """Pipe-delimited daily files: Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market.

    Lines that do not have exactly six fields are skipped, numbers that do not parse are NULL."""
    f = _content(df, "date|").select(F.split("value", r"\|", -1).alias("f")).where(F.size("f") == 6)
    return f.select(
        F.to_date(F.try_to_timestamp(F.col("f")[0], F.lit("yyyyMMdd"))).alias("date"),
        F.nullif(F.col("f")[1], F.lit("")).alias("symbol"),
        F.col("f")[2].try_cast("double").alias("short_vol"),
        F.col("f")[4].try_cast("double").alias("total_vol"),
    ).where(F.col("date").isNotNull() & F.col("symbol").isNotNull())


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return submissions(raw)


def submissions(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.coalesce(
            F.to_date(F.try_to_timestamp("FILING_DATE", F.lit("dd-MMM-yyyy"))),
            F.to_date(F.try_to_timestamp("FILING_DATE", F.lit("yyyy-MM-dd"))),
        ).alias("filing_date"),
        F.col("ISSUERCIK").try_cast("bigint").alias("cik"),
    )


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return transactions(spark.read.csv(path, sep="\t", header=True, inferSchema=False))


def transactions(raw: DataFrame) -> DataFrame:
    """Open-market trades; the plan flag is absent from older files and then means no plan."""
    plan = F.col("AFF10B5ONE") if "AFF10B5ONE" in raw.columns else F.lit(None).cast("string")
    return raw.where(F.col("TRANS_CODE").isin("P", "S")).select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        (F.upper(F.coalesce("TRANS_ACQUIRED_DISP_CD", F.lit(""))) == "A").alias("is_buy"),
        F.col("TRANS_SHARES").try_cast("double").alias("shares"),
        (F.coalesce(plan.try_cast("double"), F.lit(0.0)).cast("int") == 1).alias("is_plan"),
    ).where(F.col("shares").isNotNull())


def insider_flow(trades: DataFrame, filings: DataFrame) -> DataFrame:
    """Buy, sell and plan shares per issuer and filing day; sums combine before the shuffle."""
    j = trades.join(filings, "accession", "left").where(F.col("cik").isNotNull() & F.col("filing_date").isNotNull())
    free = ~F.col("is_plan")
    return j.groupBy("cik", "filing_date").agg(
        F.sum(F.when(free & F.col("is_buy"), F.col("shares")).otherwise(0.0)).alias("buy_shares"),
        F.sum(F.when(free & ~F.col("is_buy"), F.col("shares")).otherwise(0.0)).alias("sell_shares"),
        F.sum(F.when(F.col("is_plan"), F.col("shares")).otherwise(0.0)).alias("plan_shares"),
    )


def map_issuers(flow: DataFrame, ids: DataFrame) -> DataFrame:
    """Issuer ids to entities; issuers outside the map are dropped."""
    return flow.join(ids.select("cik", "entity"), "cik").select(
        F.col("filing_date").alias("date"), "entity", "buy_shares", "sell_shares", "plan_shares"
    )


def newest_per_key(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Keep the last arrival per key, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])
