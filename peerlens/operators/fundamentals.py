"""Quarterly statements from raw facts: first-filed values, unwound year-to-date figures,
trailing sums, fallbacks, ratios and the day each quarter became known."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite, safe_ratio

# Filing tags per item, earlier tags win.
FLOW_TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
                "SalesRevenueGoodsNet", "RevenueFromContractWithCustomerIncludingAssessedTax"],
    "gross_profit": ["GrossProfit"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "ebit": ["OperatingIncomeLoss"],
    "dep_amort": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization",
                  "DepreciationAmortizationAndAccretionNet", "Depreciation"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities",
            "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
              "PaymentsForCapitalImprovements"],
}
# Filing tags per balance item.
STOCK_TAGS = {
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "total_equity": ["StockholdersEquity",
                     "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "short_term_debt": ["LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue",
             "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "shares": ["CommonStockSharesOutstanding", "CommonStockSharesIssued", "EntityCommonStockSharesOutstanding"],
}
# Vendor statement names per item.
STATEMENT_NAMES = {
    "total_assets": ["Total Assets"],
    "total_liabilities": ["Total Liabilities Net Minority Interest", "Total Liab", "Total Liabilities"],
    "total_equity": ["Stockholders Equity", "Total Stockholder Equity", "Common Stock Equity"],
    "total_debt": ["Total Debt"],
    "long_term_debt": ["Long Term Debt"],
    "short_term_debt": ["Current Debt", "Short Long Term Debt"],
    "cash": ["Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments", "Cash"],
    "shares": ["Ordinary Shares Number", "Share Issued", "Common Stock"],
    "revenue": ["Total Revenue", "Revenue", "Operating Revenue"],
    "gross_profit": ["Gross Profit"],
    "ebitda": ["EBITDA", "Normalized EBITDA"],
    "ebit": ["EBIT", "Operating Income"],
    "net_income": ["Net Income", "Net Income Common Stockholders"],
    "dep_amort": ["Reconciled Depreciation", "Depreciation And Amortization", "Depreciation"],
    "ocf": ["Operating Cash Flow", "Cash Flow From Continuing Operating Activities",
            "Total Cash From Operating Activities"],
    "capex": ["Capital Expenditure", "Capital Expenditures", "Purchase Of PPE"],
}
FLOWS = ("revenue", "gross_profit", "net_income", "ebit", "dep_amort", "ocf", "capex")
STOCKS = ("total_assets", "total_liabilities", "total_equity", "long_term_debt", "short_term_debt", "cash", "shares")
CORE = ("revenue", "net_income", "total_assets")
REPORTING_LAG_DAYS = 60
QUARTER_DAYS = (60, 120)

ENTITY = "entity"


def _aliases(tags: Mapping[str, Sequence[str]]) -> Column:
    """tag -> (item, rank) as a literal map."""
    pairs: list[Column] = []
    for item, names in tags.items():
        for i, name in enumerate(names):
            pairs += [F.lit(name), F.struct(F.lit(item).alias("item"), F.lit(i).alias("rank"))]
    return F.create_map(*pairs)


def first_present(values: DataFrame, names: Mapping[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """One column per item: the first alternative name that has a value. Rows are (keys, name, value)."""
    wanted = sorted({n for ns in names.values() for n in ns})
    v = finite("value")
    picked = values.where(F.col("name").isin(wanted)).groupBy(*keys).agg(
        *[
            F.coalesce(*[F.max(F.when(F.col("name") == n, v)) for n in ns]).alias(item)
            for item, ns in names.items()
        ]
    )
    return picked


def merge_aliases(series: DataFrame, tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per (entity, item, end) the value of the earliest listed tag that covers that period."""
    hit = series.withColumn("__a", _aliases(tags)[F.col("tag")]).where(F.col("__a").isNotNull())
    best = hit.groupBy(ENTITY, F.col("__a.item").alias("item"), "end").agg(
        F.min_by(F.struct("val", "filed"), F.col("__a.rank")).alias("__b")
    )
    return best.select(ENTITY, "item", "end", "__b.val", "__b.filed")


def first_filed(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The earliest filed value per key; equal filing days take the smaller value."""
    ok = facts.where(F.col("filed").isNotNull() & F.col("val").isNotNull())
    best = ok.groupBy(*keys).agg(F.min(F.struct("filed", "val")).alias("__b"))
    return best.select(*keys, "__b.val", "__b.filed")


def quarterly_stock(facts: DataFrame) -> DataFrame:
    """Balance figures: first filed per (entity, tag, end)."""
    return first_filed(facts.where(F.col("end").isNotNull()), [ENTITY, "tag", "end"])


def quarterly_flow(facts: DataFrame) -> DataFrame:
    """Quarterly values of duration figures: direct 60-120 day figures win, the rest come from
    differences along each cumulative (fiscal year, start) chain."""
    lo, hi = QUARTER_DAYS
    d = facts.where(F.datediff("end", "start") >= lo)
    chain = first_filed(d, [ENTITY, "tag", "fy", "start", "end"])
    w = Window.partitionBy(ENTITY, "tag", "fy", "start").orderBy("end")  # a few period ends
    chain = chain.withColumn("__pv", F.lag("val").over(w)).withColumn("__pe", F.lag("end").over(w))
    direct = F.datediff("end", "start") <= hi
    stepped = F.datediff("end", "__pe").between(lo, hi)
    rows = chain.select(
        ENTITY,
        "tag",
        "end",
        F.explode(
            F.array(
                F.when(direct, F.struct(F.lit(0).alias("p"), "filed", "val", "fy", "start")),
                F.when(stepped, F.struct(F.lit(1).alias("p"), "filed", (F.col("val") - F.col("__pv")).alias("val"), "fy", "start")),
            )
        ).alias("__c"),
    ).where(F.col("__c").isNotNull())
    # direct figures first filed first; among derived ones the earliest chain
    order = F.struct(
        F.col("__c.p"),
        F.when(F.col("__c.p") == 0, F.col("__c.filed")).alias("f"),
        F.when(F.col("__c.p") == 0, F.col("__c.val")).alias("v"),
        F.col("__c.fy"),
        F.col("__c.start"),
    )
    best = rows.groupBy(ENTITY, "tag", "end").agg(F.min_by("__c", order).alias("__b"))
    return best.select(ENTITY, "tag", "end", "__b.val", "__b.filed")


def known_day(items: DataFrame) -> DataFrame:
    """One row per (entity, quarter_end): item columns plus ``as_of``, the latest first-filed day
    of the core items, else of any item, else quarter end + 60 days."""
    every = [*FLOWS, *STOCKS]
    core = F.col("item").isin(*CORE)
    wide = items.groupBy(ENTITY, F.col("end").alias("quarter_end")).agg(
        *[F.max(F.when(F.col("item") == i, F.col("val"))).alias(i) for i in every],
        F.max(F.when(core, F.col("filed"))).alias("__core"),
        F.max("filed").alias("__any"),
    )
    as_of = F.coalesce("__core", "__any", F.date_add("quarter_end", 60))
    present = F.coalesce(*[F.col(c) for c in CORE]).isNotNull()
    return wide.withColumn("as_of", as_of).drop("__core", "__any").where(present)


def trailing_four(col: str, order: str = "quarter_end") -> Column:
    """Sum of this and the three quarters before it, all four required."""
    w = Window.partitionBy(ENTITY).orderBy(order).rowsBetween(-3, 0)
    return F.when(F.count(col).over(w) == 4, F.sum(col).over(w))


def strict_trailing_four(col: str, order: str = "quarter_end", span_days: int = 300) -> Column:
    """As ``trailing_four`` but the four rows must lie within one year."""
    w = Window.partitionBy(ENTITY).orderBy(order)
    return F.when(F.datediff(order, F.lag(order, 3).over(w)) <= span_days, trailing_four(col, order))


def year_on_year(df: DataFrame, order: Sequence[str] = ("as_of", "quarter_end")) -> DataFrame:
    """Changes against four rows back in knowledge order."""
    w = Window.partitionBy(ENTITY).orderBy(*order)

    def back(c: str) -> Column:
        return F.lag(c, 4).over(w)

    return df.select(
        "*",
        (F.col("roe") - back("roe")).alias("roe_yoy"),
        (F.col("gross_margin") - back("gross_margin")).alias("gross_margin_yoy"),
        (safe_ratio("total_assets", back("total_assets")) - 1).alias("asset_growth_yoy"),
        (safe_ratio("shares", back("shares")) - 1).alias("net_issuance_yoy"),
    )


def null_aware_sum(a: str, b: str) -> Column:
    """a + b with a missing side as zero; NULL only when both are missing."""
    return F.when(
        F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    )


def _ratios(q: DataFrame, debt: Column) -> DataFrame:
    equity = F.coalesce(F.col("total_equity"), F.col("total_assets") - F.col("total_liabilities"))
    out = q.withColumn("__eq", equity).select(
        ENTITY,
        "as_of",
        "quarter_end",
        "net_income_ttm",
        "ebitda_ttm",
        "revenue_ttm",
        "fcf_ttm",
        debt.alias("total_debt"),
        "cash",
        "shares",
        "total_assets",
        safe_ratio("net_income_ttm", "__eq").alias("roe"),
        safe_ratio("net_income_ttm", "total_assets").alias("roa"),
        safe_ratio("gross_profit_ttm", "revenue_ttm").alias("gross_margin"),
        safe_ratio("fcf_ttm", "revenue_ttm").alias("fcf_margin"),
        safe_ratio("ocf_ttm", "net_income_ttm").alias("accruals_ocf_ni"),
    )
    return year_on_year(out)


def factors_from_items(items: DataFrame, strict: bool = False) -> DataFrame:
    """Fundamental factor rows keyed by knowledge day from (entity, item, end, val, filed)."""
    ttm = strict_trailing_four if strict else trailing_four
    q = known_day(items)
    q = q.select("*", *[ttm(c).alias(f"{c}_ttm") for c in FLOWS])
    q = q.withColumn("ebitda_ttm", F.col("ebit_ttm") + F.abs("dep_amort_ttm")).withColumn(
        "fcf_ttm", F.col("ocf_ttm") - F.abs("capex_ttm")
    )
    return _ratios(q, null_aware_sum("long_term_debt", "short_term_debt"))


def factors_from_statements(values: DataFrame) -> DataFrame:
    """The same factors from vendor statements (entity, quarter_end, name, value): known 60 days
    after quarter end; debt stays missing when both parts are zero or missing."""
    q = first_present(values, STATEMENT_NAMES, [ENTITY, "quarter_end"])
    q = q.withColumn("as_of", F.date_add("quarter_end", REPORTING_LAG_DAYS))
    q = q.select("*", *[trailing_four(c).alias(f"{c}_ttm") for c in (*FLOWS, "ebitda")])
    q = q.withColumn("ebitda_ttm", F.coalesce("ebitda_ttm", F.col("ebit_ttm") + F.abs("dep_amort_ttm"))).withColumn(
        "fcf_ttm", F.col("ocf_ttm") - F.abs("capex_ttm")
    )
    parts = F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0))
    any_part = (F.coalesce("long_term_debt", F.lit(0.0)) != 0) | (F.coalesce("short_term_debt", F.lit(0.0)) != 0)
    return _ratios(q, F.coalesce("total_debt", F.when(any_part, parts)))


def fundamentals(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Raw (entity, tag, start, end, val, filed, fy) facts to factor rows.

    Where facts carry a ``taxonomy``, tags are those of us-gaap, and of dei for share counts only: the
    same tag of another taxonomy is another item."""
    if "taxonomy" in facts.columns:
        cover = (F.col("taxonomy") == "dei") & F.col("tag").isin(STOCK_TAGS["shares"])
        facts = facts.where((F.col("taxonomy") == "us-gaap") | cover)
    flow_tags = [t for ts in FLOW_TAGS.values() for t in ts]
    stock_tags = [t for ts in STOCK_TAGS.values() for t in ts]
    flows = merge_aliases(quarterly_flow(facts.where(F.col("tag").isin(flow_tags))), FLOW_TAGS)
    stocks = merge_aliases(quarterly_stock(facts.where(F.col("tag").isin(stock_tags))), STOCK_TAGS)
    return factors_from_items(flows.unionByName(stocks), strict)


def valuation(df: DataFrame, price: str = "close") -> DataFrame:
    """Price-based ratios from a fundamental row and the price known on the day."""
    p = finite(price)
    ok = (F.col("shares") > 0) & p.isNotNull()
    cap = F.when(ok, p * F.col("shares"))
    ev = cap + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    d = df.withColumn("__cap", cap).withColumn("__ev", ev)
    return d.select(
        *df.columns,
        F.when(F.col("net_income_ttm") > 0, F.try_divide("__cap", "net_income_ttm")).alias("pe_ratio"),
        F.when(F.col("ebitda_ttm") > 0, F.try_divide("__ev", "ebitda_ttm")).alias("ev_to_ebitda"),
        F.when(F.col("revenue_ttm") > 0, F.try_divide("__cap", "revenue_ttm")).alias("ps_ratio"),
        F.when(F.col("__ev") > 0, F.try_divide("fcf_ttm", "__ev")).alias("fcf_yield"),
    )
