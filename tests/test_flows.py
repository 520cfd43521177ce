"""Cleaning, flags, ratios, transactions, trends and summaries on small ledgers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hoplens.functions.time import bucket
from hoplens.operators.clean import clean_ledger
from hoplens.operators.flows import (account_flows, account_trend, recent_summary,
                                     transactions, trend)
from hoplens.operators.labels import FLAG, blacklist_ratio, flag
from hoplens.operators.report import seed_report
from hoplens.plans.sinks import with_percent

DAY = 86400


def test_clean_drops_zero_and_null_keeps_nan(ledger_of):
    led = ledger_of([(1, "A", "B", 0.0), (2, "A", "B", None), (3, "A", "B", float("nan")),
                     (4, "A", "B", 2.0), (None, "A", "B", 1.0), (99, "A", "B", 1.0)])
    got = clean_ledger(led, 0, 50).collect()
    assert sorted(r.timestamp for r in got) == [3, 4]
    assert any(math.isnan(r.value) for r in got)
    assert clean_ledger(led).count() == 4  # no window: null timestamp kept


def test_flag_ignores_duplicate_blacklist_rows(spark, ids_of):
    n = spark.createDataFrame([("S", "B", "S", 1), ("S", "C", "S", 1)],
                              "seed_id string, id string, originalAddress string, label int")
    got = flag(n, ids_of(["B", "B"], "blacklist")).collect()
    assert sorted((r.id, r[FLAG]) for r in got) == [("B", True), ("C", False)]


def test_ratio_and_empty_seed(spark, ids_of):
    flagged = spark.createDataFrame([("S", "B", True), ("S", "C", False), ("S", "D", False)],
                                    f"seed_id string, id string, {FLAG} boolean")
    got = {r.seed_id: r for r in blacklist_ratio(flagged, ids_of(["S", "E"])).collect()}
    assert got["S"].black_count == 1 and got["S"].total_count == 3
    assert abs(got["S"].ratio - 1 / 3) < 1e-12
    assert got["E"].total_count == 0 and got["E"].ratio is None
    text = with_percent(blacklist_ratio(flagged, ids_of(["S"]))).collect()[0].percent
    assert text == "33.33%"


def test_transactions_bag_semantics(spark, ledger_of):
    led = ledger_of([(1, "A", "A", 5.0), (2, "A", "B", 1.0), (3, "A", "B", 1.0),
                     (4, "C", "A", 2.0)])
    acc = spark.createDataFrame([("S", "A")], "seed_id string, id string")
    tx = transactions(led, acc, tz="UTC").collect()
    assert sorted(r.timestamp for r in tx) == [1, 1, 2, 3, 4]  # self-transfer twice
    assert tx[0].time.startswith("1970-01-01 00:00:0")


def test_trend_gap_days_and_lag(spark, ledger_of):
    led = ledger_of([(1 * DAY, "A", "X", 1.0), (1 * DAY + 5, "A", "Y", 2.0),
                     (5 * DAY, "A", "X", 4.0), (None, "A", "X", 8.0)])
    acc = spark.createDataFrame([("S", "A")], "seed_id string, id string")
    t = trend(account_flows(led, acc), "day", ("seed_id", "direction"), tz="UTC").collect()
    got = sorted((r.date, r["count"], r.yesterday_count, r.growth, r.total_amount) for r in t)
    assert got == [("1970-01-02", 2, None, None, 3.0), ("1970-01-06", 1, 2, -1, 4.0)]
    total = sum(r["count"] for r in t)
    assert total == account_flows(led, acc).where(F.col("timestamp").isNotNull()).count()


def test_trend_units_and_account_trend(spark, ledger_of, ids_of):
    led = ledger_of([(3600, "S", "X", 1.0), (7200, "X", "S", 2.0), (40 * DAY, "S", "Y", 3.0)])
    hourly = trend(account_flows(led, spark.createDataFrame([("S", "S")], "seed_id string, id string")),
                   "hour", tz="UTC").collect()
    assert sorted(r.hour for r in hourly) == ["1970-01-01 01", "1970-01-01 02", "1970-02-10 00"]
    monthly = account_trend(led, ids_of(["S"]), "month", tz="UTC").collect()
    assert sorted((r.direction, r.month, r["count"]) for r in monthly) == [
        ("from", "1970-01", 1), ("from", "1970-02", 1), ("to", "1970-01", 1)]
    hod = account_trend(led, ids_of(["S"]), "hour_of_day", tz="UTC").collect()
    assert sorted((r.date, r.hour) for r in hod)[0] == ("1970-01-01", "01")


def test_bucket_time_zone(spark):
    df = spark.createDataFrame([(0,)], "t long")
    r = df.select(bucket("t", "hour", "Asia/Shanghai").alias("h"),
                  bucket("t", "hour", "UTC").alias("u")).collect()[0]
    assert (r.h, r.u) == ("1970-01-01 08", "1970-01-01 00")


def test_recent_summary_and_report(spark, ledger_of, ids_of):
    led = ledger_of([(10, "B", "X", 1.5), (20, "Y", "B", 2.25), (30, "B", "B", 1.0),
                     (500, "B", "X", 100.0)])
    flagged = spark.createDataFrame(
        [("S", "B", "S", 1, True), ("S", "C", "S", 1, False), ("S", "B", "C", 2, True)],
        f"seed_id string, id string, originalAddress string, label int, {FLAG} boolean")
    summ = recent_summary(led, flagged, 0, 100, ids_of(["S", "T"]), amount_scale=2)
    got = {r.seed_id: (r.total_amount, r.tx_count) for r in summ.collect()}
    assert got == {"S": (5.75, 4), "T": (None, 0)}  # self-transfer on both sides
    rep = {r.seed_id: r for r in seed_report(flagged, summ, ids_of(["S", "T"])).collect()}
    assert (rep["S"].hop1_count, rep["S"].hop2_count, rep["S"].black_count) == (2, 1, 2)
    assert rep["T"].neighbour_count == 0 and rep["T"].ratio is None


def test_trends_rollup_equals_direct(spark, ledger_of):
    from hoplens.operators.flows import trends

    rows = [(i * 977, "A" if i % 3 else "X", "B" if i % 2 else "A", float(i % 7) + 0.25)
            for i in range(400)]
    led = ledger_of(rows)
    acc = spark.createDataFrame([("S", "A")], "seed_id string, id string")
    flows = account_flows(led, acc)
    got = trends(flows, ("day", "hour", "month", "hour_of_day"), ("seed_id", "direction"),
                 tz="UTC", amount_scale=2)
    for unit, df in got.items():
        direct = trend(flows, unit, ("seed_id", "direction"), tz="UTC", amount_scale=2)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, direct.collect())), unit


def test_buckets_ignore_a_dst_session_zone(spark):
    import datetime as dt

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts = [1699162200 + i * 900 for i in range(12)]  # around the 2023-11-05 DST change
        df = spark.createDataFrame([(t,) for t in ts], "t long")
        got = [r.h for r in df.select(bucket("t", "datetime", "UTC").alias("h")).orderBy("t").collect()]
        want = [dt.datetime.fromtimestamp(t, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for t in ts]
        assert got == want
        sh = df.select(bucket("t", "hour", "Asia/Shanghai").alias("h")).orderBy("t").first().h
        assert sh == "2023-11-05 13"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
