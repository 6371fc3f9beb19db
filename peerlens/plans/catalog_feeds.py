"""Feeds: text, delimited and JSON documents rendered by Spark from the given tables, then
parsed by the same code that reads files; cleaning rules; overrides; flows; whole panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import asof, calendar, checks, evaluation as ev, fundamentals as fu, overrides as ovr, panel as pn, timeseries as ts
from ..sources import documents, tables, text
from . import views as v
from .catalog_series import FEATS, L, M, S, _FEAT, _FWD, _ITEMS_SQL, _REACT, _forward, off, supplier_items, truncation_invariance
from .reference_sql import VIEWS, with_views
from .registry import SQL, big, query, r6, tidy


def part_overrides(spark, sf):
    """One override per returned line: filed at shipment, expiring 100 days later."""
    li = v.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    day = F.to_date("l_shipdate")
    return li.select(day.alias("date"), F.col("l_partkey").alias("entity"), F.date_add(day, 100).alias("expires"))


# --- scans and text ---------------------------------------------------------------------


@query("pruned_parquet_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity),2) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def pruned_parquet_scan(spark, sf):
    d = tables.read_table(spark, f"{sf}/lineitem.parquet").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def membership_lines(spark, sf):
    """One CSV line per customer. Every third company name carries bare commas, every fifth is
    quoted, every seventh line is a comment, every eleventh is too short, every thirteenth blank."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat("c_name", F.lit(", Inc., NY"))).when(k % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit(', Ltd"'))).otherwise(F.col("c_name"))
    end = F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("1999-12-31"))
    full = F.concat_ws(",", F.concat(F.lit(" ab."), k.cast("string")), name, "c_mktsegment", F.lit("1996-01-01"), end, F.lit("note"))
    line = F.when(k % 7 == 0, F.concat(F.lit("# "), full)).when(k % 11 == 0, F.lit("only,three,fields")).when(k % 13 == 0, F.lit("   ")).otherwise(full)
    return v.table(spark, sf, "customer").select(line.alias("value"))


@query(
    "membership_csv_repaired",
    """SELECT 'AB-'||c_custkey AS entity, CASE WHEN c_custkey%3=0 THEN c_name||', Inc., NY' WHEN c_custkey%5=0 THEN c_name||', Ltd' ELSE c_name END AS company, c_mktsegment AS sector, DATE '1996-01-01' AS start_date,
 CASE WHEN c_custkey%2=0 THEN NULL ELSE DATE '1999-12-31' END AS end_date, 'note' AS delist_note FROM customer WHERE c_custkey%7<>0 AND c_custkey%11<>0 AND c_custkey%13<>0""",
)
def membership_csv_repaired(spark, sf):
    return text.membership(membership_lines(spark, sf))


@query(
    "override_log_validated",
    """SELECT CASE WHEN o_orderkey%10=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, 'E'||o_custkey AS entity, CASE WHEN o_orderkey%12=0 THEN '' ELSE 'ana' END AS analyst,
 CASE WHEN o_orderkey%14=0 THEN 'sideways' WHEN o_orderkey%2=0 THEN 'less_risky' ELSE 'more_risky' END AS direction, CASE WHEN o_orderkey%15=0 THEN 'hunch' ELSE 'data_error' END AS reason_code,
 CASE WHEN o_orderkey%10=0 THEN CASE WHEN o_orderkey%4=0 THEN DATE '2002-01-01' END WHEN o_orderkey%4=0 THEN DATE '2002-01-01' ELSE CAST(CAST(o_orderdate AS DATE)+INTERVAL 6 MONTH AS DATE) END AS expires,
 o_orderkey%10<>0 AND o_orderkey%12<>0 AND o_orderkey%14<>0 AND o_orderkey%15<>0 AS valid FROM orders WHERE o_orderkey%9<>0""",
)
def override_log_validated(spark, sf):
    k = F.col("o_orderkey")
    line = F.concat_ws(
        ",", F.when(k % 10 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit(" e"), F.col("o_custkey").cast("string"), F.lit(" ")),
        F.when(k % 12 == 0, F.lit("")).otherwise(F.lit("ana")), F.when(k % 14 == 0, "sideways").when(k % 2 == 0, "less_risky").otherwise("more_risky"),
        F.when(k % 15 == 0, "hunch").otherwise("data_error"), F.lit("f_px"), F.lit('"a, note"'), F.when(k % 4 == 0, F.lit("2002-01-01")).otherwise(F.lit("")),
    )
    rows = v.table(spark, sf, "orders").select(F.when(k % 9 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))
    return text.overrides(rows).select("date", "entity", "analyst", "direction", "reason_code", "expires", "valid")


@query("override_rejects", "SELECT reason_code, direction, count(*) AS n FROM (SELECT CASE WHEN o_orderkey%14=0 THEN 'sideways' ELSE 'less_risky' END AS direction, CASE WHEN o_orderkey%15=0 THEN 'hunch' ELSE 'data_error' END AS reason_code FROM orders) WHERE direction='sideways' OR reason_code='hunch' GROUP BY 1,2")
def override_rejects(spark, sf):
    k = F.col("o_orderkey")
    raw = v.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_custkey").cast("string").alias("entity"), F.lit("ana").alias("analyst"),
        F.when(k % 14 == 0, "sideways").otherwise("less_risky").alias("direction"), F.when(k % 15 == 0, "hunch").otherwise("data_error").alias("reason_code"),
        F.lit("").alias("factor"), F.lit("").alias("note"), F.lit("").alias("expires"),
    )
    return ovr.rejected(ovr.typed_overrides(raw)).groupBy("reason_code", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("holdings_csv", "SELECT upper(p_brand)||'-'||p_partkey AS entity, CASE WHEN p_partkey%3=0 THEN p_name ELSE '' END AS note FROM part WHERE p_partkey%4<>0")
def holdings_csv(spark, sf):
    k = F.col("p_partkey")
    line = F.concat(F.lit(" "), "p_brand", F.lit("-"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(", "), "p_name")).otherwise(F.lit("")))
    rows = v.table(spark, sf, "part").select(F.when(k % 8 == 0, F.concat(F.lit("#"), line)).when(k % 4 == 0, F.lit("ticker,note")).otherwise(line).alias("value"))
    return text.holdings(rows)


@query(
    "short_volume_files",
    """SELECT CAST(ts AS DATE) AS date, 'U/'||user_id AS symbol, CASE WHEN event_id%17=0 THEN NULL ELSE value END AS short_vol, value*2 AS total_vol FROM events WHERE event_id%19<>0 AND event_id%23<>0""",
)
def short_volume_files(spark, sf):
    k = F.col("event_id")
    line = F.concat_ws(
        "|", F.when(k % 23 == 0, F.lit("2024XX01")).otherwise(F.date_format("ts", "yyyyMMdd")), F.concat(F.lit("U/"), F.col("user_id").cast("string")),
        F.when(k % 17 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")), F.lit("0"), (F.col("value") * 2).cast("string"), F.lit("B,Q,N"),
    )
    rows = v.table(spark, sf, "events").select(F.when(k % 19 == 0, F.concat(line, F.lit("|extra"))).otherwise(line).alias("value"))
    return text.short_volume(rows)


def _filings(spark, sf):
    """Orders as submissions, line items as trades; orders of every 20th key are missing their issuer."""
    o = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("FILING_DATE"),
        F.when(F.col("o_orderkey") % 20 != 0, F.col("o_custkey").cast("string")).alias("ISSUERCIK"),
    )
    li = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"), F.when(F.col("l_returnflag") == "R", "G").when(F.col("l_returnflag") == "A", "P").otherwise("S").alias("TRANS_CODE"),
        F.when(F.col("l_linestatus") == "F", "a").otherwise("D").alias("TRANS_ACQUIRED_DISP_CD"), F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_quantity").cast("string")).alias("TRANS_SHARES"),
        F.when(F.col("l_linenumber") == 1, "1").when(F.col("l_linenumber") == 2, "").otherwise("0").alias("AFF10B5ONE"),
    )
    return li, o


_INS = """SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filing_date, sum(CASE WHEN l_linenumber<>1 AND l_linestatus='F' THEN l_quantity ELSE 0.0 END) AS buy_shares,
 sum(CASE WHEN l_linenumber<>1 AND l_linestatus<>'F' THEN l_quantity ELSE 0.0 END) AS sell_shares, sum(CASE WHEN l_linenumber=1 THEN l_quantity ELSE 0.0 END) AS plan_shares
 FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_returnflag<>'R' AND l_linenumber<>7 AND o_orderkey%20<>0 GROUP BY 1,2"""


@query("insider_flow_by_issuer", _INS)
def insider_flow_by_issuer(spark, sf):
    li, o = _filings(spark, sf)
    # two-digit English month names arrive in upper case
    subs = text.submissions(o.withColumn("FILING_DATE", F.initcap(F.lower("FILING_DATE"))))
    return text.insider_flow(text.transactions(li), subs)


@query("insider_flow_without_plan_column", "SELECT count(*) AS n, round(sum(l_quantity),2) AS shares FROM lineitem WHERE l_returnflag<>'R' AND l_linenumber<>7")
def insider_flow_without_plan_column(spark, sf):
    li, _ = _filings(spark, sf)
    t = text.transactions(li.drop("AFF10B5ONE")).where(~F.col("is_plan"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shares"), 2).alias("shares"))


@query("insider_flow_mapped", f"SELECT filing_date AS date, c_name AS entity, buy_shares, sell_shares, plan_shares FROM ({_INS}) JOIN (SELECT * FROM customer WHERE c_acctbal>0) ON c_custkey=cik")
def insider_flow_mapped(spark, sf):
    li, o = _filings(spark, sf)
    subs = text.submissions(o.withColumn("FILING_DATE", F.initcap(F.lower("FILING_DATE"))))
    ids = v.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("entity"))
    return text.map_issuers(text.insider_flow(text.transactions(li), subs), ids)


@query("newest_row_per_key", "SELECT user_id AS entity, CAST(ts AS DATE) AS date, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1,2")
def newest_row_per_key(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "event_type", "event_id")
    return text.newest_per_key(e, ["entity", "date"], "event_id")


# --- documents -------------------------------------------------------------------------------


@query("event_properties", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def event_properties(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "statement_documents_round_trip",
    """SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS VARCHAR) AS "column", l_returnflag AS name, round(sum(l_extendedprice),2) AS value FROM lineitem GROUP BY 1,2,3""",
)
def statement_documents_round_trip(spark, sf):
    cells = v.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("name"), F.year("l_shipdate").cast("string").alias("column")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    # a document needs the same columns on every row, so missing cells are written as null
    years = cells.select("entity", "column").distinct()
    names = cells.select("entity", "name").distinct()
    full = names.join(years, "entity").join(cells, ["entity", "name", "column"], "left")
    docs = documents.to_split_frame(full)
    return documents.split_frame(docs, "doc").where(F.col("value").isNotNull())


def _xbrl(spark, sf):
    """Nested documents per supplier: revenue in USD for even keys and EUR for odd ones, plus shares."""
    f = v.ytd_facts(spark, sf)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    fact = F.struct(day("start").alias("start"), day("end").alias("end"), F.col("val"), day("filed").alias("filed"), F.col("fy"))
    g = f.groupBy("entity").agg(F.collect_list(fact).alias("a"))
    unit = F.when(F.col("entity") % 2 == 0, F.lit("USD")).otherwise(F.lit("EUR"))
    units = F.create_map(unit, F.col("a"), F.lit("zzz"), F.slice("a", 1, 1))
    revenue = F.create_map(F.lit("Revenues"), F.struct(units.alias("units")))
    other = F.create_map(F.lit("Misc"), F.struct(F.create_map(F.lit("shares"), F.slice("a", 1, 1)).alias("units")))
    return g.select("entity", F.to_json(F.create_map(F.lit("us-gaap"), revenue, F.lit("dei"), other)).alias("doc"))


@query(
    "filing_documents_flattened",
    with_views("""SELECT entity, 'us-gaap' AS taxonomy, 'Revenues' AS tag, CASE WHEN entity%2=0 THEN 'USD' ELSE 'EUR' END AS unit, start, "end", val, filed, fy FROM ytd""", "ytd"),
)
def filing_documents_flattened(spark, sf):
    f = documents.filing_facts(_xbrl(spark, sf)).where(F.col("taxonomy") == "us-gaap")
    return tidy(f)


@query(
    "earnings_filings_extracted",
    """SELECT o_custkey AS entity, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, CAST(CAST(o_orderdate AS DATE) AS VARCHAR)||'T'||lpad(CAST(o_orderkey%24 AS VARCHAR),2,'0')||':30:00.000Z' AS accepted FROM orders WHERE o_orderstatus='F' AND o_orderkey%3<>0""",
)
def earnings_filings_extracted(spark, sf):
    return documents.earnings_filings(_filing_docs(spark, sf))


def _filing_docs(spark, sf):
    o = v.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "8-K/A").otherwise("10-Q")
    items = F.when(F.col("o_orderkey") % 3 == 0, "5.02").otherwise("2.02,9.01")
    acc = F.concat(day, F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30:00.000Z"))
    # filings come in pages: a page covers a thousand order keys, so a document is bounded
    page = F.floor(F.col("o_orderkey") / 1000)
    g = o.groupBy(F.col("o_custkey").alias("entity"), page.alias("page")).agg(F.collect_list(F.struct(form.alias("form"), items.alias("items"), day.alias("d"), acc.alias("a"))).alias("r"))
    pick = lambda n: F.transform("r", lambda x: x[n])
    return g.select("entity", F.to_json(F.struct(pick("form").alias("form"), pick("items").alias("items"), pick("d").alias("filingDate"), pick("a").alias("acceptanceDateTime"))).alias("doc"))


@query(
    "earnings_reaction_days",
    """SELECT DISTINCT entity, CASE WHEN hour(l)>=16 THEN CAST(l AS DATE) + CASE isodow(l) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END ELSE CAST(l AS DATE) END AS reaction_date FROM (
 SELECT o_custkey AS entity, (CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey%24) + to_minutes(30)) + to_hours(CASE WHEN d >= s AND d < f THEN -4 ELSE -5 END) AS l FROM (
  SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey%24) + to_minutes(30) AS d,
   make_date(year(o_orderdate),4,1) + ((7-isodow(make_date(year(o_orderdate),4,1)))%7)::INT + INTERVAL 7 HOUR AS s, make_date(year(o_orderdate),10,31) - (isodow(make_date(year(o_orderdate),10,31))%7)::INT + INTERVAL 6 HOUR AS f
  FROM orders WHERE o_orderstatus='F' AND o_orderkey%3<>0))""",
)
def earnings_reaction_days(spark, sf):
    return documents.earnings_events(_filing_docs(spark, sf))


# --- shapes -------------------------------------------------------------------------------------


@query("wide_to_long", "SELECT o_custkey, 'O' AS entity, CAST(count(*) AS DOUBLE) AS close FROM orders WHERE o_orderstatus='O' GROUP BY 1 UNION ALL SELECT o_custkey, 'F', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus='F' GROUP BY 1")
def wide_to_long(spark, sf):
    o = v.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.lit(1.0).alias("one"))
    wide = tables.long_to_wide(o, "o_custkey", "o_orderstatus", "one", ["O", "F"], "sum")
    return tables.wide_to_long(wide, ["o_custkey"])


@query(
    "long_to_wide_last_first",
    """SELECT o_custkey, max_by(o_totalprice,o_orderkey) FILTER (o_orderstatus='O') AS last_o, min_by(o_totalprice,o_orderkey) FILTER (o_orderstatus='O') AS first_o FROM orders GROUP BY 1""",
)
def long_to_wide_last_first(spark, sf):
    o = v.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("arrival"))
    a = tables.long_to_wide(o, "o_custkey", "o_orderstatus", "o_totalprice", ["O"], "last").withColumnRenamed("O", "last_o")
    b = tables.long_to_wide(o, "o_custkey", "o_orderstatus", "o_totalprice", ["O"], "first").withColumnRenamed("O", "first_o")
    return a.join(b, "o_custkey")


@query("normalised_keys", "SELECT p_partkey, replace(upper(trim('  '||p_name||'.b ')),'.','-') AS k, replace('a/'||p_brand,'/','-') AS d, replace('a-'||p_brand,'-','/') AS s FROM part")
def normalised_keys(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select(
        "p_partkey", sc.market_key(F.concat(F.lit("  "), "p_name", F.lit(".b "))).alias("k"), sc.slash_to_dash(F.concat(F.lit("a/"), "p_brand")).alias("d"),
        sc.dash_to_slash(F.concat(F.lit("a-"), "p_brand")).alias("s"),
    )


@query("safe_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax/nullif(l_discount,0) AS q, round(CASE WHEN l_discount=0 THEN NULL ELSE l_tax END,4) AS r FROM lineitem")
def safe_ratios(spark, sf):
    li = v.table(spark, sf, "lineitem")
    odd = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", sc.safe_ratio("l_tax", "l_discount").alias("q"), sc.clean_round(odd).alias("r"))


@query(
    "first_present_alias",
    """SELECT o_custkey AS entity, coalesce(max(CASE WHEN o_orderpriority='1-URGENT' THEN o_totalprice END), max(CASE WHEN o_orderpriority='2-HIGH' THEN o_totalprice END)) AS top, coalesce(max(CASE WHEN o_orderpriority='5-LOW' THEN o_totalprice END), max(CASE WHEN o_orderpriority='3-MEDIUM' THEN o_totalprice END)) AS low
 FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH','5-LOW','3-MEDIUM') GROUP BY 1""",
)
def first_present_alias(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"))
    return fu.first_present(o, {"top": ["1-URGENT", "2-HIGH"], "low": ["5-LOW", "3-MEDIUM"]}, ["entity"])


@query("rows_with_every_value", "SELECT count(*) AS n FROM (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus='F') AS f, max(o_totalprice) FILTER (o_orderpriority='1-URGENT') AS u FROM orders GROUP BY 1) WHERE f IS NOT NULL AND u IS NOT NULL")
def rows_with_every_value(spark, sf):
    o = v.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("u")
    )
    return o.dropna(subset=["f", "u"]).agg(F.count(F.lit(1)).alias("n"))


@query("selection_and_date_floor", with_views("SELECT date, count(*) AS n FROM panel WHERE index_name='SMALL' AND date>=DATE '1999-01-01' GROUP BY 1", "panel"))
def selection_and_date_floor(spark, sf):
    d = v.panel(spark, sf).where((F.col("index_name") == "SMALL") & (F.col("date") >= F.lit("1999-01-01").cast("date")))
    return d.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("risk_tier_labels", "SELECT p_partkey, CASE WHEN p_size<>7 THEN CASE WHEN p_size*2.0<30 THEN 'Stable' WHEN p_size*2.0<70 THEN 'Mainstream' ELSE 'Elevated' END ELSE 'Unknown' END AS tier FROM part")
def risk_tier_labels(spark, sf):
    from ..operators.peers import RISK_TIERS

    pct = F.when(F.col("p_size") != 7, F.col("p_size") * 2.0)
    return v.table(spark, sf, "part").select("p_partkey", sc.tier_of(pct, RISK_TIERS).alias("tier"))


@query("positive_flow_share", with_views("SELECT entity, date, round(short_vol/total_vol,6) AS ratio FROM flow WHERE total_vol>0", "flow"))
def positive_flow_share(spark, sf):
    return tidy(ts.flow_ratio(v.flow(spark, sf)), "entity", "date", "ratio")


@query("weekday_spans", "SELECT o_orderkey, (SELECT count(*) FROM range(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE)+CAST(o_orderkey%40 AS INTEGER), INTERVAL 1 DAY) t(d) WHERE isodow(d)<6) AS n FROM orders")
def weekday_spans(spark, sf):
    d = F.to_date("o_orderdate")
    end = F.date_add(d, (F.col("o_orderkey") % 40).cast("int"))
    return v.table(spark, sf, "orders").select("o_orderkey", sc.weekdays_between(d, end).cast("long").alias("n"))


@query("daily_event_flow", with_views("SELECT entity, date, buy_shares, sell_shares FROM flow", "flow"))
def daily_event_flow(spark, sf):
    return v.flow(spark, sf).select("entity", "date", "buy_shares", "sell_shares")


# --- overrides against outcomes --------------------------------------------------------------------

_OBS = """SELECT o.reason_code, o.direction, p.rel, (p.rel<0) = (o.direction='more_risky') AS ok FROM (SELECT l_partkey AS entity, CAST(l_shipdate AS DATE) AS filed, CAST(l_shipdate AS DATE)+100 AS expires, CASE WHEN l_orderkey%2=0 THEN 'less_risky' ELSE 'more_risky' END AS direction,
 CASE l_linenumber%3 WHEN 0 THEN 'data_error' WHEN 1 THEN 'new_information' ELSE 'thesis_disagreement' END AS reason_code FROM lineitem WHERE l_returnflag='R') o JOIN (SELECT entity, date, fwd_rel_ret_1q AS rel FROM panel WHERE fwd_rel_ret_1q IS NOT NULL) p ON p.entity=o.entity AND p.date BETWEEN o.filed AND o.expires"""


@query(
    "override_scoreboard",
    with_views(
        "SELECT coalesce(reason_code,'ALL') AS reason_code, count(*) AS n_obs, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END),6) AS analyst_hit_rate, round(1-avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END),6) AS model_hit_rate, round(avg(rel),6) AS avg_rel_ret FROM ob GROUP BY GROUPING SETS ((reason_code),())",
        "panel", extra={"ob": _OBS},
    ),
)
def override_scoreboard(spark, sf):
    li = v.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    day = F.to_date("l_shipdate")
    reason = F.when(F.col("l_linenumber") % 3 == 0, "data_error").when(F.col("l_linenumber") % 3 == 1, "new_information").otherwise("thesis_disagreement")
    o = li.select(
        F.col("l_partkey").alias("entity"), F.lit("ana").alias("analyst"), F.when(F.col("l_orderkey") % 2 == 0, "less_risky").otherwise("more_risky").alias("direction"),
        reason.alias("reason_code"), day.alias("date"), F.date_add(day, 100).alias("expires"),
    )
    return tidy(ovr.scoreboard(ovr.scored_observations(o, v.panel(spark, sf), "fwd_rel_ret_1q")))


@query("overrides_in_force", "SELECT l_partkey AS entity, count(*) AS n FROM lineitem WHERE l_returnflag='R' AND CAST(l_shipdate AS DATE)<=DATE '1999-06-30' AND CAST(l_shipdate AS DATE)+100>=DATE '1999-06-30' GROUP BY 1")
def overrides_in_force(spark, sf):
    return asof.active_on(part_overrides(spark, sf), "1999-06-30").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# --- warehouse-shaped reads ------------------------------------------------------------------------


@query(
    "delisting_events_named",
    """SELECT o_custkey AS permno, c_name AS ticker, CAST(o_orderdate AS DATE) AS dlstdt, CAST(o_orderkey%5*100 AS INTEGER) AS dlstcd, o_totalprice AS dlret FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderdate>=TIMESTAMP '1998-01-01' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
)
def delisting_events_named(spark, sf):
    e = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("permno"), F.to_date("o_orderdate").alias("dlstdt"), (F.col("o_orderkey") % 5 * 100).cast("int").alias("dlstcd"), F.col("o_totalprice").alias("dlret")
    )
    n = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("permno"), F.col("c_name").alias("ticker"), F.lit("1997-01-01").cast("date").alias("namedt"), F.lit("1999-12-31").cast("date").alias("nameenddt")
    )
    return tables.join_names(e, n, "1998-01-01")


# --- whole panel ----------------------------------------------------------------------------------------


def _brand_membership(spark, sf):
    """Brands are members from their tenth week on; every sixth brand left at the start of 2000."""
    b = v.bars_raw(spark, sf).groupBy("entity").agg(F.min("date").alias("first"))
    k = F.substring("entity", 7, 9).cast("int")
    return b.select(
        "entity", F.col("entity").alias("company"), F.when(k % 2 == 0, "EVEN").otherwise("ODD").alias("sector"), F.date_add("first", 70).alias("start_date"),
        F.when(k % 6 == 0, F.lit("2000-01-03").cast("date")).alias("end_date"), F.lit("").alias("delist_note"),
    )


_HZ = {"1m": 4, "1q": 12, "2q": 24, "4q": 48}


def assembled(spark, sf, **feeds):
    supplier_rows = fu.factors_from_items(supplier_items(spark, sf))
    brands = supplier_rows.withColumn("supplier", F.col("entity")).withColumn("entity", F.concat(F.lit("Brand#"), (F.col("entity") % 25 + 1).cast("string")))
    one = asof.latest_per_day(brands, "as_of", ["quarter_end", "total_assets", "supplier"], [c for c in brands.columns if c not in ("entity", "as_of")])
    return pn.build_panel(
        v.bars_raw(spark, sf), _brand_membership(spark, sf), None, "CORE", v.bench(spark, sf), one, month=S, quarter=M, year=L, half_year=2 * M, half_year_least=M,
        horizons=_HZ, large=v.large(spark, sf), **feeds,
    )


_PBASE = ["mom_12_1", "reversal_1m", "high_52w", "max_ret_1m", "beta_252d", "amihud_63d"]
_PANEL_SQL = {
    **_FEAT,
    "mem": "SELECT entity, CASE WHEN CAST(substr(entity,7) AS BIGINT)%2=0 THEN 'EVEN' ELSE 'ODD' END AS sector, min(date)+70 AS s, CASE WHEN CAST(substr(entity,7) AS BIGINT)%6=0 THEN DATE '2000-01-03' END AS e FROM bars GROUP BY 1,2",
    "pts": "SELECT r.date, m.entity, m.sector, session_no FROM mem m JOIN rebal r ON s<=r.date AND r.date<=coalesce(e, DATE '9999-12-31') JOIN sessions USING (date)",
    "cf": "SELECT entity, date, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}" for c in _PBASE)
    + " FROM g2",
    "an": "SELECT * FROM (SELECT *, close/lag(close) OVER (PARTITION BY entity ORDER BY session_no) AS ratio FROM bars) WHERE ratio>4 OR ratio<0.25",
    **{
        f"fw_{n}": f"""SELECT p.entity, p.date, CASE WHEN f.close IS NOT NULL AND EXISTS (SELECT 1 FROM an WHERE an.entity=p.entity AND an.session_no>p.session_no AND an.session_no<=p.session_no+{h}) THEN NULL
 WHEN abs(f.close/b.close-1)>50 THEN NULL WHEN f.close IS NULL AND l.lv < (SELECT max(date) FROM sessions)-15 AND l.lv>p.date AND l.lv<coalesce(s.date, p.date+{int(h * 1.5)}) THEN -1.0 ELSE f.close/b.close-1 END AS r FROM pts p
 ASOF JOIN bars b ON b.entity=p.entity AND p.session_no>=b.session_no LEFT JOIN bars f ON f.entity=p.entity AND f.session_no=p.session_no+{h} LEFT JOIN sessions s ON s.session_no=p.session_no+{h} LEFT JOIN (SELECT entity, max(date) AS lv FROM bars GROUP BY 1) l ON l.entity=p.entity"""
        for n, h in _HZ.items()
    },
    "pp": "SELECT p.date, p.entity, p.sector, " + ", ".join(_PBASE) + ", " + ", ".join(f"fw_{n}.r AS fwd_ret_{n}" for n in _HZ) + " FROM pts p LEFT JOIN cf ON cf.entity=p.entity AND cf.date=p.date "
    + " ".join(f"LEFT JOIN fw_{n} ON fw_{n}.entity=p.entity AND fw_{n}.date=p.date" for n in _HZ),
}
_PRET = [f"fwd_ret_{n}" for n in _HZ]


@query(
    "panel_assembled",
    with_views(
        f"SELECT date, entity, sector, 'CORE' AS index_name, {r6(*_PBASE, *_PRET)}, " + ", ".join(f"round({c}-median({c}) OVER (PARTITION BY date, sector),6) AS {c.replace('ret', 'rel_ret')}" for c in _PRET) + " FROM pp",
        "grid", "mkt", "rebal", extra=_PANEL_SQL,
    ),
)
def panel_assembled(spark, sf):
    p, _ = assembled(spark, sf)
    return tidy(p, "date", "entity", "sector", "index_name", *_PBASE, *_PRET, *[c.replace("ret", "rel_ret") for c in _PRET])


_STATED = {
    **_ITEMS_SQL,
    **_PANEL_SQL,
    "one": "SELECT * FROM (SELECT 'Brand#' || (entity%25+1) AS entity, * EXCLUDE (entity), row_number() OVER (PARTITION BY entity%25, as_of ORDER BY quarter_end DESC NULLS LAST, total_assets DESC NULLS LAST, entity DESC) AS no FROM fy) WHERE no=1",
    "iv": "SELECT entity, date, last_value(iv IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS ivol_63d FROM "
    "(SELECT entity, date, CASE WHEN vi IS NOT NULL AND b63 IS NOT NULL THEN sqrt(greatest(0,vi-b63*b63*vq)) END AS iv FROM g2)",
    "st": "SELECT p.date, p.entity, o.* EXCLUDE (entity), p.fwd_ret_1q, p.fwd_ret_2q FROM pp p ASOF LEFT JOIN one o ON o.entity=p.entity AND p.date>=o.as_of",
    "val": "SELECT s.*, CASE WHEN shares>0 THEN b.close*shares END AS cap FROM st s ASOF LEFT JOIN (SELECT entity, date, close FROM bars WHERE close IS NOT NULL) b ON b.entity=s.entity AND s.date>=b.date",
}


@query(
    "panel_assembled_with_statements",
    with_views(
        "SELECT v.date, v.entity, as_of AS fund_as_of, round(roe,6) AS roe, round(gross_margin,6) AS gross_margin, round(CASE WHEN net_income_ttm>0 THEN cap/net_income_ttm END,6) AS pe_ratio, "
        "round(CASE WHEN cap+coalesce(total_debt,0)>0 THEN fcf_ttm/(cap+coalesce(total_debt,0)) END,6) AS fcf_yield, round(ivol_63d,6) AS ivol_63d, "
        "coalesce(fwd_ret_1q=-1.0,false) OR coalesce(fwd_ret_2q=-1.0,false) AS delisted FROM val v LEFT JOIN iv ON iv.entity=v.entity AND iv.date=v.date",
        "grid", "mkt", "rebal", extra=_STATED,
    ),
)
def panel_assembled_with_statements(spark, sf):
    p, _ = assembled(spark, sf)
    return tidy(p.select("date", "entity", "fund_as_of", "roe", "gross_margin", "pe_ratio", "fcf_yield", "ivol_63d", "delisted"))


def _brand_lines(spark, sf, day):
    """Line items of each brand, reduced by part and day first."""
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    li = v.table(spark, sf, "lineitem").groupBy(day.alias("date"), "l_partkey").agg(
        of("R").alias("r"), of("N").alias("n"), of("A").alias("a"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("disc"), F.sum("l_tax").alias("tax"),
        F.count(F.lit(1)).alias("lines"), F.min(F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))).alias("first"),
    )
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    sums = [F.sum(c).alias(c) for c in ("r", "n", "a", "q", "disc", "tax", "lines")]
    return li.join(part, "l_partkey").groupBy("entity", "date").agg(*sums, F.min("first").alias("first"))


def _every_feed(spark, sf):
    """Returned quantity as shorts, new and returned-by-agreement quantity as buys and sells, the first return of a quarter as
    earnings day, monthly discounts and taxes as estimates, the brand's number as short float."""
    day = F.to_date("l_shipdate")
    weekly = v.kept(_brand_lines(spark, sf, F.trunc(day, "week")))
    monthly = _brand_lines(spark, sf, F.last_day(day))
    brands = v.table(spark, sf, "part").select(F.col("p_brand").alias("entity")).distinct()
    return {
        "short_flow": weekly.select("entity", "date", F.col("r").alias("short_vol"), F.col("q").alias("total_vol")),
        "insider_flow": weekly.select("entity", "date", F.col("n").alias("buy_shares"), F.col("a").alias("sell_shares")),
        "earnings": _brand_lines(spark, sf, F.trunc(day, "quarter")).where(F.col("first").isNotNull()).select("entity", F.col("first").alias("reaction_date")),
        "estimates": monthly.select(
            "entity", F.col("date").alias("est_as_of"), F.round(F.col("disc") / F.col("lines"), 9).alias("est_revision_3m"), F.round(F.col("tax") / F.col("lines"), 9).alias("sue")
        ),
        "short_float": brands.select("entity", (F.substring("entity", 7, 9).cast("int") / 100.0).alias("short_pct_float")),
    }


_BRAND = "lineitem JOIN part ON p_partkey=l_partkey"
_QTY = "sum(CASE WHEN l_returnflag='{0}' THEN l_quantity ELSE 0 END)"
_FRAME = "(PARTITION BY entity ORDER BY session_no RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"
_CARRY = "last_value({0} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS {0}"
_EVERY = {
    **{k: _PANEL_SQL[k] for k in ("mem", "pts")},
    "wk": f"SELECT p_brand AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_QTY.format('R')} AS r, {_QTY.format('N')} AS n, {_QTY.format('A')} AS a, sum(l_quantity) AS q FROM {_BRAND} GROUP BY 1,2",
    "cells": "SELECT e.entity, s.date, s.session_no FROM (SELECT DISTINCT entity FROM wk) e CROSS JOIN sessions s",
    "sl": f"SELECT *, CASE WHEN count(ratio) OVER w>=21 THEN avg(ratio) OVER w END AS short_vol_ratio FROM (SELECT c.*, r/q AS ratio FROM cells c LEFT JOIN wk USING (entity, date)) WINDOW w AS {_FRAME.format(62)}",
    "sc": "SELECT *, short_vol_ratio - max(short_vol_ratio) OVER (PARTITION BY entity ORDER BY session_no RANGE BETWEEN 63 PRECEDING AND 63 PRECEDING) AS short_vol_chg FROM sl",
    "shorts": f"SELECT entity, date, {_CARRY.format('short_vol_ratio')}, {_CARRY.format('short_vol_chg')} FROM sc",
    "np": f"""SELECT entity, date, CASE WHEN session_no+1>={M} AND b+s>0 THEN (b-s)/(b+s) END AS npr FROM (SELECT *, sum(buy) OVER w AS b, sum(sell) OVER w AS s FROM (
 SELECT c.*, coalesce(n,0) AS buy, coalesce(a,0) AS sell FROM cells c LEFT JOIN wk USING (entity, date) WHERE c.date <= (SELECT max(date) FROM wk)) WINDOW w AS {_FRAME.format(2 * M - 1)})""",
    "ev1": f"SELECT p_brand AS entity, min(CAST(l_shipdate AS DATE)) AS reaction_date FROM {_BRAND} WHERE l_returnflag='R' GROUP BY 1, date_trunc('quarter', l_shipdate)",
    "ev0": "SELECT entity, reaction_date FROM (SELECT *, date_diff('day', lag(reaction_date) OVER (PARTITION BY entity ORDER BY reaction_date), reaction_date) AS gap FROM ev1) WHERE gap IS NULL OR gap>28",
    **{k: _REACT[k] for k in ("evs", "re")},
    "est": f"SELECT p_brand AS entity, last_day(CAST(l_shipdate AS DATE)) AS est_as_of, round(avg(l_discount),9) AS est_revision_3m, round(avg(l_tax),9) AS sue FROM {_BRAND} GROUP BY 1,2",
    "w": """SELECT p.date, p.entity, s.short_vol_ratio, s.short_vol_chg, n.npr AS insider_npr_6m, p.session_no FROM pts p LEFT JOIN shorts s ON s.entity=p.entity AND s.date=p.date
 LEFT JOIN np n ON n.entity=p.entity AND n.date=least(p.date, (SELECT max(date) FROM np))""",
    "wr": "SELECT w.*, CASE WHEN w.session_no-re.session_no<=70 THEN re.reaction END AS earn_react_1q FROM w ASOF LEFT JOIN re ON re.entity=w.entity AND w.session_no>=re.session_no",
}


@query(
    "panel_with_every_feed",
    with_views(
        f"SELECT wr.date, wr.entity, {r6('short_vol_ratio', 'short_vol_chg', 'insider_npr_6m', 'earn_react_1q')}, est_revision_3m, sue, CAST(substr(wr.entity,7) AS INTEGER)/100.0 AS short_pct_float "
        "FROM wr ASOF LEFT JOIN est ON est.entity=wr.entity AND wr.date>=est.est_as_of",
        "grid", "mkt", "rebal", extra=_EVERY,
    ),
)
def panel_with_every_feed(spark, sf):
    p, _ = assembled(spark, sf, **_every_feed(spark, sf))
    return tidy(p.select("date", "entity", "short_vol_ratio", "short_vol_chg", "insider_npr_6m", "earn_react_1q", "est_revision_3m", "sue", "short_pct_float"), exact=("est_revision_3m", "sue"))


_CHECKS = f"""SELECT 'no_label_in_features' AS "check", true AS passed, '{len(v.FACTORS)} features, leaks: []' AS detail
UNION ALL SELECT 'membership_point_in_time', true, CASE WHEN min(start_date)<>max(start_date) OR bool_or(end_date IS NOT NULL) THEN 'point-in-time store present' ELSE 'current-only membership is survivorship biased' END FROM membership
UNION ALL SELECT 'truncation_invariance', sum(checked)>0, 'checked ' || sum(checked) || ', mismatches ' || sum(mismatches) FROM ({SQL['truncation_invariance']})
UNION ALL SELECT 'delisting_carried', carried>0 AND scored>0, 'carried ' || carried || ', survivors ' || scored FROM (SELECT count(CASE WHEN entity=e AND ret=-1.0 THEN 1 END) AS carried,
 count(CASE WHEN entity<>e THEN ret END) AS scored FROM f1 CROSS JOIN (SELECT min(entity) AS e FROM f1 WHERE ret=-1.0))"""


@query(
    "integrity_report",
    with_views(
        """SELECT * FROM c UNION ALL SELECT 'all', bool_and(passed), count(CASE WHEN NOT passed THEN 1 END) || ' failed' FROM c""",
        "membership", "sessions", "rebal", extra={**{k: x for k, x in _FWD.items() if k != "f2"}, "c": _CHECKS},
    ),
)
def integrity_report(spark, sf):
    """Labels kept out of features, the kind of membership store, no look-ahead, and the terminal return of a name that stopped trading."""
    forward = _forward(spark, sf, {"1q": 12}).select("entity", F.col("ret_1q").alias("ret"))
    stopped = forward.where(F.col("ret") == -1.0).agg(F.min("entity")).first()[0]
    return checks.report(
        checks.no_label_in_features(v.neutral(spark, sf)),
        checks.membership_honesty(asof.has_history(v.membership(spark, sf))),
        checks.nothing_seen_ahead(truncation_invariance(spark, sf)),
        checks.delisting_carried(forward, stopped),
    )
