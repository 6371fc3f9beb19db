"""The given tables seen as panels, bars, filings and flows.

Each view is a pushed-down scan and one combinable aggregate; dimensions join after the fact
table has been reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import labels, peers, ranking, scoring
from ..operators.calendar import session_calendar, with_sessions
from ..session import held

FACTORS = {"f_disc": -1, "f_tax": -1, "f_ret": 1, "f_qty": 1, "f_px": 1, "f_lines": -1, "f_supp": 1}
FAMILIES = {"Price": ["f_px", "f_disc"], "Quality": ["f_ret", "f_tax", "f_supp"], "Volume": ["f_qty", "f_lines"]}
FAMILY_OF = {f: g for g, fs in FAMILIES.items() for f in fs}
INTERACTIONS = {"ix_price_x_quality": ("Price", "Quality"), "ix_volume_x_price": ("Volume", "Price")}
HORIZONS = {"1q": 1, "2q": 2, "4q": 4}
MONTHS = {"1q": 3, "2q": 6, "4q": 12}
FEATURES = [f"{f}__n" for f in FACTORS]
SELECTION = "SMALL"
SHORT, MID, LONG = 4, 12, 52


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_ROWS: dict[tuple, int] = {}
#: Rows of line items a task of the peer chain is meant to get; its sorts and windows then stay small however long the table is.
TASK_ROWS = 250_000


def most_rows(spark: SparkSession, sf: str, name: str, *by) -> int:
    """Rows of a source, or of its largest group of ``by``; counted once for each state of its files, not once a call."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    seen = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path)
    state = (spark.sparkContext.applicationId, str(path), seen.getLength(), seen.getFileCount(), str(by))
    if state not in _ROWS:
        rows = table(spark, sf, name)
        _ROWS[state] = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 if by else rows.count()
    return _ROWS[state]


def large(spark: SparkSession, sf: str, name: str = "part") -> bool | None:
    """False if the whole source fits one ranking group, else None: operators then look up the groups themselves.

    A panel has at most one row per part and date, so the parts bound every group that holds a date."""
    return False if most_rows(spark, sf, name) <= ranking.TARGET_GROUP_ROWS else None


def large_peers(spark: SparkSession, sf: str) -> bool | None:
    """The same for peer groups: the parts of one sector and index bound them on every date."""
    return False if most_rows(spark, sf, "part", *_peers()) <= ranking.TARGET_GROUP_ROWS else None


def large_selected(spark: SparkSession, sf: str, most: int | None = None) -> bool | None:
    """The same for dates of the selected rows alone: the parts of one index bound them."""
    return False if most_rows(spark, sf, "part", _peers()[1]) <= (most or ranking.TARGET_GROUP_ROWS) else None


def dealt(spark: SparkSession, sf: str, df: DataFrame, *keys: str, always: bool = False) -> DataFrame:
    """Rows moved by ``keys`` into as many tasks as the line items ask for; where the session has that many anyway, moved only if ``always``."""
    tasks = most_rows(spark, sf, "lineitem") // TASK_ROWS
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys) if always else df


def kept(df: DataFrame, *cols: str) -> DataFrame:
    """The columns several branches read, held once the plan runs."""
    return held(df.select(*cols) if cols else df)


def _peers() -> list[Column]:
    """Sector and index of a part."""
    return [F.col("p_type").alias("sector"), F.when(F.col("p_size") <= 25, "SMALL").otherwise("LARGE").alias("index_name")]


def shipments(spark: SparkSession, sf: str, unit: str = "quarter") -> DataFrame:
    """Panel rows before scoring: (date, entity) aggregates of line items, with part attributes.

    A part has few line items a date and hardly two of one supplier, so partial sums are as many rows as the line items and wider;
    the items themselves move instead, once, where the distinct count would move its sums twice. They move by part, so that the
    rows of its dates meet the part and their later prices where they are summed."""
    li = table(spark, sf, "lineitem").select(
        F.trunc(F.to_date("l_shipdate"), unit).alias("date"), F.col("l_partkey").alias("entity"), "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )
    agg = dealt(spark, sf, li, "entity", always=True).groupBy("date", "entity").agg(
        F.round(F.avg("l_discount"), 9).alias("f_disc"),
        F.round(F.avg("l_tax"), 9).alias("f_tax"),
        F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 9).alias("f_ret"),
        F.round(F.sum("l_quantity"), 6).alias("f_qty"),
        F.round(F.log(F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")), 9).alias("f_px"),
        (F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity") + 50000).alias("px"),
        F.count(F.lit(1)).cast("double").alias("f_lines"),
        F.countDistinct("l_suppkey").cast("double").alias("f_supp"),
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), *_peers())
    return agg.join(part, "entity")


def period_number(unit: str = "quarter"):
    if unit == "quarter":
        return F.year("date") * 4 + F.quarter("date")
    return F.year("date") * 12 + F.month("date")


def _forward(spark: SparkSession, sf: str, unit: str) -> tuple[DataFrame, dict[str, str]]:
    """Shipments with forward returns of a price (unit price on a fixed base), and their names once relative to peers."""
    d = shipments(spark, sf, unit).withColumn("period_no", period_number(unit))
    scale = 1 if unit == "quarter" else 3
    steps = {f"fwd_ret_{n}": k * scale for n, k in HORIZONS.items()}
    if unit == "month":
        steps = {"fwd_ret_1m": 1, **steps}
    return labels.gap_returns(d, "px", steps), {c: c.replace("fwd_ret", "fwd_rel_ret") for c in steps}


def _in_peer_groups(spark: SparkSession, sf: str, unit: str, *steps, move: bool = True, only: str | None = None) -> DataFrame:
    """Peer-relative returns, then ``steps(rows, large)``, all inside peer groups: split by size once for the whole chain.

    ``move`` false leaves rows where they were summed, for readers of no peer column: Spark then drops the windows, but never a move.
    With ``only``, rows of other indexes stay as rows of their groups, their numbers and entities left out."""
    d, rel = _forward(spark, sf, unit)
    if only:
        numbers = {"entity", "px", *FACTORS, *rel}
        d = d.select(*[F.when(F.col("index_name") == only, F.col(c)).alias(c) if c in numbers else c for c in d.columns])

    def chain(rows: DataFrame, large: bool) -> DataFrame:
        rows = peers.relative_to_median(rows, rel, large=large)
        for step in steps:
            rows = step(rows, large)
        return rows

    return ranking.sized(dealt(spark, sf, d, *peers.PEER_KEYS) if move else d, peers.PEER_KEYS, large_peers(spark, sf), chain)


def _z(rows: DataFrame, large: bool) -> DataFrame:
    return peers.neutralize(rows, FACTORS, large=large)


def _score(rows: DataFrame, large: bool) -> DataFrame:
    return scoring.balanced_score(rows, FAMILIES, large=large)


def _cross(rows: DataFrame, large: bool) -> DataFrame:
    return scoring.interactions(rows, INTERACTIONS, large=large)


def panel(spark: SparkSession, sf: str, unit: str = "quarter", move: bool = True) -> DataFrame:
    return _in_peer_groups(spark, sf, unit, move=move)


def neutral(spark: SparkSession, sf: str, unit: str = "quarter") -> DataFrame:
    return _in_peer_groups(spark, sf, unit, _z)


def scored(spark: SparkSession, sf: str, unit: str = "quarter") -> DataFrame:
    return _in_peer_groups(spark, sf, unit, _z, _score)


def crossed(spark: SparkSession, sf: str, unit: str = "quarter", only: str | None = None) -> DataFrame:
    """Scored rows with the interactions of their families."""
    return _in_peer_groups(spark, sf, unit, _z, _score, _cross, only=only)


def risked(spark: SparkSession, sf: str, unit: str = "quarter") -> DataFrame:
    """Risk by date next to the score; only these columns are written where groups have to be looked up."""
    d = scored(spark, sf, unit).select("date", "entity", "sector", "index_name", "score_ew", "decile_ew", "fwd_ret_1q", *FACTORS)
    return peers.absolute_risk(d, FACTORS, large=large(spark, sf))


def bars_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per brand, reduced by part first so only sums meet the part dimension."""
    li = table(spark, sf, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "week").alias("date"), "l_partkey").agg(
        F.sum("l_extendedprice").alias("x"), F.sum("l_quantity").alias("q")
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    return li.join(part, "l_partkey").groupBy("entity", "date").agg(
        (F.round(F.sum("x"), 2) / F.sum("q")).alias("close"), F.round(F.sum("q"), 6).alias("volume")
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly calendar, straight from the ship dates (one narrow column)."""
    d = table(spark, sf, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "week").alias("date"))
    return session_calendar(d)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return with_sessions(bars_raw(spark, sf), sessions(spark, sf))


def bench(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "week").alias("date"))
    return li.agg((F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("close"))


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """First to last order of each customer; still open when the last order is recent."""
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    span = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.min("d").alias("start_date"), F.max("d").alias("last"))
    top = o.agg(F.max("d").alias("top"))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector")
    )
    end = F.when(F.datediff("top", "last") > 90, F.col("last"))
    return span.join(F.broadcast(top), F.lit(True)).join(c, "entity").select(
        "entity", "company", "sector", "start_date", end.alias("end_date"), F.lit("").alias("delist_note")
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts known 60 days later."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), F.date_add(F.to_date("o_orderdate"), 60).alias("as_of"),
        F.to_date("o_orderdate").alias("quarter_end"), F.col("o_orderkey").alias("order_no"), F.col("o_totalprice").alias("value"),
    )


def quarter_grid(spark: SparkSession, sf: str) -> DataFrame:
    """(date, entity) of the shipping panel's quarters x customers that ordered in them."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.last_day(F.to_date("o_orderdate")).alias("date"))
    return o.distinct()


def ytd_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative revenue per supplier, year and quarter, filed 30 days after quarter end."""
    li = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("entity"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("q")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("flow"))
    w = Window.partitionBy("entity", F.year("q")).orderBy("q")
    end = F.last_day(F.add_months("q", 2))
    return li.select(
        "entity", F.lit("Revenues").alias("tag"), F.trunc("q", "year").alias("start"), end.alias("end"),
        F.round(F.sum("flow").over(w), 2).alias("val"), F.date_add(end, 30).alias("filed"), F.year("q").alias("fy"), "flow",
    )


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and day: purchases as buys, errors as sells, views as shorts, all as total."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"))

    def of(kind: str):
        return F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)), 6)

    return e.agg(
        of("purchase").alias("buy_shares"), of("error").alias("sell_shares"), of("view").alias("short_vol"),
        F.round(F.sum("value"), 6).alias("total_vol"),
    )


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    return session_calendar(table(spark, sf, "events").select(F.to_date("ts").alias("date")))


def signups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("reaction_date")
    )
