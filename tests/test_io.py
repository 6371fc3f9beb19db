"""Files in, files out, and incremental feeds."""

import datetime as dt

from pyspark.sql import functions as F

from peerlens.sources import tables, text
from peerlens.streaming import feeds

D = dt.date


def test_partitioned_table_and_records(spark, tmp_path):
    d = spark.createDataFrame([("a", D(2020, 1, 1), 1.5), ("b", D(2021, 1, 1), float("nan")), ("c", None, None)], "entity string, date date, v double")
    tables.write_table(d, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"))
    assert back.where("year = 2020").count() == 1 and back.count() == 3
    tables.write_records(d, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"entity":"a","date":"2020-01-01","v":1.5}', '{"entity":"b","date":"2021-01-01","v":null}', '{"entity":"c","date":null,"v":null}']


def test_membership_store_round_trip(spark, tmp_path):
    p = tmp_path / "m"
    p.mkdir()
    (p / "part.csv").write_text('# note\nticker,company,sector,start,end,delist\nbrk.b,"Berk, Inc",Fin,2020-01-01,,\nX,Bad, Co, Ltd,Tech,2020-01-01,2021-01-01,gone\nshort,row\nY,NoNote,Tech,2020-01-01,\nZ,Bad date,Tech,soon,,\n\n')
    got = {r.entity: r for r in text.membership(text.lines(spark, str(p))).collect()}
    assert set(got) == {"BRK-B", "X", "Y"}
    assert got["BRK-B"].company == "Berk, Inc" and got["X"].company == "Bad, Co, Ltd" and got["X"].end_date == D(2021, 1, 1)
    tables.append_snapshot(spark.createDataFrame([("N", "New, Co", "Tech", D(2022, 1, 1), None, None)], "entity string, company string, sector string, start_date date, end_date date, delist_note string"), str(p))
    again = {r.entity: r for r in text.membership(text.lines(spark, str(p))).collect()}
    assert set(again) == {"BRK-B", "X", "Y", "N"} and again["N"].company == "New, Co" and again["N"].end_date is None


def test_tab_separated_feeds(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\nA1\t05-JAN-2020\t7\nA2\t2020-01-06\t\n".replace("JAN", "Jan"))
    (tmp_path / "t.tsv").write_text("ACCESSION_NUMBER\tTRANS_CODE\tTRANS_ACQUIRED_DISP_CD\tTRANS_SHARES\nA1\tP\tA\t10\nA1\tS\tD\t4\nA1\tG\tA\t99\nA1\tS\tA\tx\nA2\tP\tA\t5\n")
    flow = text.insider_flow(text.read_transactions(spark, str(tmp_path / "t.tsv")), text.read_submissions(spark, str(tmp_path / "s.tsv"))).collect()
    assert [tuple(r) for r in flow] == [(7, D(2020, 1, 5), 10.0, 4.0, 0.0)]


def test_state_round_trip(spark, tmp_path):
    p = str(tmp_path / "state")
    tables.save_state(spark.range(1).select(F.lit(True).alias("promoted"), F.lit(None).cast("double").alias("paired_t")), p)
    tables.save_state(spark.range(1).select(F.lit(False).alias("promoted"), F.lit(1.2).alias("paired_t")), p)
    assert [tuple(r) for r in tables.load_state(spark, p, "promoted boolean, paired_t double").collect()] == [(False, 1.2)]


def test_standard_quarters(spark):
    base = {c: None for c in tables.QUARTERLY_COLUMNS}
    row = {**base, "gvkey": "1", "datadate": D(2020, 3, 31), "indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C"}
    schema = ", ".join(f"{c} {'date' if c in ('datadate', 'rdq') else 'string'}" for c in [*tables.QUARTERLY_COLUMNS, "indfmt", "datafmt", "popsrc", "consol"])
    d = spark.createDataFrame([row, {**row, "indfmt": "FS"}, {**row, "datadate": D(2009, 3, 31)}], schema)
    out = tables.standard_quarters(d, "2010-01-01")
    assert out.count() == 1 and out.columns == list(tables.QUARTERLY_COLUMNS)


def _drop(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_latest_arrival_wins_across_batches_and_files_are_taken_once(spark, tmp_path):
    src, root, log = str(tmp_path / "in"), str(tmp_path / "st"), str(tmp_path / "log")
    schema = "entity string, date date, v double, arrival long"
    store = feeds.MonthlyStore(spark, root)
    run = lambda: feeds.upsert_latest(feeds.landing(spark, src, schema), store, ["entity", "date"], "arrival", log).awaitTermination()
    _drop(spark, [("a", D(2020, 1, 1), 1.0, 1), ("a", D(2020, 2, 1), 2.0, 2), ("a", D(2020, 1, 1), 1.5, 3)], src, schema)
    run()
    _drop(spark, [("a", D(2020, 1, 1), 9.0, 4), ("b", D(2020, 1, 5), 7.0, 5)], src, schema)
    run()
    run()  # nothing new
    got = sorted((r.entity, r.date, r.v) for r in store.read().collect())
    assert got == [("a", D(2020, 1, 1), 9.0), ("a", D(2020, 2, 1), 2.0), ("b", D(2020, 1, 5), 7.0)]
    assert feeds.ledger(spark, log).count() == 2


def test_bars_top_up_rescales_history_without_rewriting_it(spark, tmp_path):
    src, root, log = str(tmp_path / "in"), str(tmp_path / "st"), str(tmp_path / "log")
    schema = "entity string, date date, close double, volume double"
    store = feeds.MonthlyStore(spark, root)
    seen = []
    run = lambda: feeds.upsert_bars(feeds.landing(spark, src, schema), store, log, lambda v: seen.append({r.entity: r.verdict for r in v.collect()})).awaitTermination()
    jan = [D(2020, 1, 27), D(2020, 1, 28), D(2020, 1, 29)]
    _drop(spark, [(e, D(2019, 6, 3), 100.0, 1.0) for e in "ab"] + [(e, d, 100.0, 1.0) for e in "ab" for d in jan], src, schema)
    run()
    # b split two for one: the fresh window is half the stored one; c is new
    _drop(spark, [("a", d, 100.0, 2.0) for d in jan[1:]] + [("b", d, 50.0, 2.0) for d in jan[1:]] + [("b", D(2020, 1, 30), 51.0, 2.0), ("c", D(2020, 1, 30), 5.0, 1.0)], src, schema)
    run()
    got = {(r.entity, r.date): (r.close, r.volume) for r in store.read().collect()}
    assert seen == [{"a": "keep", "b": "rescale"}]
    assert got[("b", D(2019, 6, 3))] == (50.0, 1.0) and got[("b", jan[0])] == (50.0, 1.0) and got[("b", jan[1])] == (50.0, 2.0)
    assert got[("a", D(2019, 6, 3))] == (100.0, 1.0) and got[("c", D(2020, 1, 30))] == (5.0, 1.0) and len(got) == 10
    raw = {(r.entity, r.date): r.close for r in store.raw().collect()}
    assert raw[("b", D(2019, 6, 3))] == 100.0  # untouched month
    # a window that covers too few names is skipped
    _drop(spark, [("a", D(2020, 2, 3), 1.0, 1.0)], src, schema)
    run()
    assert store.read().count() == 10


def test_streamed_flow_equals_batch(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    src = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(t0 + dt.timedelta(hours=7 * i), i % 3, ("purchase", "error", "view")[i % 3 if i % 4 else 0], float(i)) for i in range(60)]
    for k in range(0, 60, 20):
        _drop(spark, rows[k : k + 20], src, schema)
    store = feeds.MonthlyStore(spark, str(tmp_path / "st"))
    feeds.publish_flow(feeds.daily_flow(feeds.landing(spark, src, schema, 1), late="30 days"), store, str(tmp_path / "log")).awaitTermination()
    cols = ["entity", "date", "buy_shares", "sell_shares"]
    batch = feeds.daily_flow(spark.createDataFrame(rows, schema)).select(*cols)
    got = store.read().select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() > 20


def _bars(spark, tmp_path):
    schema = "entity string, date date, close double, volume double"
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    store = feeds.MonthlyStore(spark, str(tmp_path / "st"))

    def run(rows):
        _drop(spark, rows, src, schema)
        feeds.upsert_bars(feeds.landing(spark, src, schema), store, log).awaitTermination()
        return {(r.entity, r.date): r.close for r in store.read().collect()}, store.read().count()

    return store, run


def test_bars_repeated_in_a_batch_are_kept_once(spark, tmp_path):
    store, run = _bars(spark, tmp_path)
    d = D(2020, 1, 6)
    got, n = run([("a", d, 1.0, 1.0), ("a", d, 1.0, 1.0), ("b", d, 2.0, 1.0)])
    assert n == 2
    got, n = run([("a", D(2020, 1, 7), 3.0, 1.0), ("a", D(2020, 1, 7), 3.0, 1.0), ("b", D(2020, 1, 7), 2.0, 1.0)])
    assert n == 4 and got[("a", D(2020, 1, 7))] == 3.0


def test_bars_that_disagree_wait_for_the_whole_history(spark, tmp_path):
    store, run = _bars(spark, tmp_path)
    days = [D(2020, 1, 6), D(2020, 1, 7), D(2020, 2, 3)]
    run([(e, d, 100.0, 1.0) for e in "ab" for d in days])
    got, n = run([("a", days[1], 50.0, 1.0), ("a", days[2], 77.0, 1.0), ("b", days[2], 100.0, 1.0), ("a", D(2020, 2, 4), 78.0, 1.0)])
    assert n == 6 and {got[("a", d)] for d in days} == {100.0}
    assert {(r.entity, r.verdict) for r in store.verdicts().collect()} == {("a", "refetch")}
    assert store.pending().count() == 3
    got, n = run([("a", D(2020, 2, 5), 79.0, 1.0), ("b", D(2020, 2, 5), 100.0, 1.0)])  # no overlap: still waiting
    assert ("a", D(2020, 2, 5)) not in got and n == 7
    got, n = run([("a", d, 10.0 + i, 1.0) for i, d in enumerate([*days, D(2020, 2, 4)])] + [("b", D(2020, 2, 6), 100.0, 1.0)])
    assert [got[("a", d)] for d in [*days, D(2020, 2, 4)]] == [10.0, 11.0, 12.0, 13.0] and n == 9
    assert store.waiting(99).count() == 0
    got, n = run([("a", D(2020, 2, 5), 14.0, 1.0), ("b", D(2020, 2, 7), 100.0, 1.0)])
    assert got[("a", D(2020, 2, 5))] == 14.0 and n == 11


def test_year_partitions_are_spread(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "date_add(date'2020-01-01', cast(id % 700 as int)) as date")
    tables.write_table(df, str(tmp_path / "t"), tasks_per_year=3)
    back = tables.read_table(spark, str(tmp_path / "t"))
    assert back.select("id", "date").exceptAll(df).count() == 0 and back.count() == 4000
    files = list((tmp_path / "t").glob("year=2020/*.parquet"))
    assert 1 <= len(files) <= 3


def test_written_stages_are_released(spark):
    import os

    from peerlens import session

    held = session._WRITTEN[:]
    session._WRITTEN.clear()
    session._HELD.clear()
    d = session.durable(spark.range(5))
    path = session._WRITTEN[-1]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and d.count() == 5
    rows = session.held(spark.range(3))
    assert rows.count() == 3 and rows.storageLevel.useDisk
    assert session.release(spark) == 2 and not os.path.exists(path) and not rows.storageLevel.useDisk
    session._WRITTEN.extend(held)


def test_rows_later_than_any_watermark_count(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    src, root, log = str(tmp_path / "in"), str(tmp_path / "st"), str(tmp_path / "log")
    day = dt.datetime(2024, 1, 1, 12)
    for rows in ([(day, 1, "purchase", 1.0), (day + dt.timedelta(days=90), 1, "error", 5.0)], [(day, 1, "purchase", 2.0)]):
        _drop(spark, rows, src, schema)
        feeds.add_flow(feeds.landing(spark, src, schema), root, log).awaitTermination()
    got = {r.date: (r.buy_shares, r.sell_shares) for r in feeds.added_flow(spark, root).collect()}
    assert got == {D(2024, 1, 1): (3.0, 0.0), D(2024, 3, 31): (0.0, 5.0)}


def test_shuffles_behind_a_written_table_are_deleted(spark):
    """The files of a finished write go, those of held rows and of other plans stay, and the setting is as it was."""
    import glob
    import time

    from pyspark.sql import functions as F

    from peerlens import session

    def files():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
        return {f for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True)}

    d = spark.range(50_000).select("id", (F.col("id") * F.rand(3)).alias("x"))
    kept = session.held(d.repartition(3, "x"))
    moved = d.repartition(5, "x")
    before = files()
    out = session.durable(kept.groupBy((F.col("id") % 7).alias("g")).count().join(moved.groupBy((F.col("id") % 7).alias("g")).count().toDF("g", "n"), "g"))
    for _ in range(50):
        left = {f.rsplit("/", 1)[1].split("_")[1] for f in files() - before}
        if len(left) == 1:
            break
        time.sleep(0.2)
    assert len(left) == 1  # the shuffle of the held rows
    assert spark.conf.get(session._CLEANUP) == "false"
    assert out.count() == 7 and kept.count() == moved.count() == 50_000
