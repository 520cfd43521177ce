"""Stored graph, balls, cube, stages, completion records and exact sums."""

from __future__ import annotations

import contextlib
import io
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hoplens.functions.amounts import exact_sum
from hoplens.functions.time import timestamp_to_epoch
from hoplens.operators import adjacency, clean, cube, explore, flows
from hoplens.operators.expand import khop
from hoplens.plans import sinks, stages, strategy
from hoplens.plans.pipeline import StudyConfig, run_study
from hoplens.sources import fixtures as fx


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def random_edges(n=300, accounts=40, seed=0):
    rng = random.Random(seed)
    name = lambda: f"x{rng.randrange(accounts):03d}"
    return [(i, name(), None if i % 97 == 0 else name(), float(i % 7)) for i in range(n)]


# --- stored graph ---------------------------------------------------------------

@pytest.mark.parametrize("caps", [None, (3, 4, 2)])
def test_shared_expansion_equals_the_ledger_scan(ledger_of, ids_of, tmp_path, caps):
    led = ledger_of(random_edges())
    seeds = ids_of([f"x{i:03d}" for i in range(0, 40, 3)] + ["absent"])
    graph = adjacency.build_graph(led, str(tmp_path / "g"), parts=4)
    got = adjacency.khop_shared(graph, seeds, 3, caps)
    want = khop(led, seeds, hops=3, caps=caps, require_labelled=False)
    cols = ("seed_id", "id", "originalAddress", "label")
    assert rows_of(got, *cols) == rows_of(want, *cols)


def test_a_hub_is_expanded_once_for_all_seeds(ledger_of, ids_of, tmp_path):
    """100 seeds around one hub: pairs and frontier rows do not multiply with the seeds."""
    edges = [(1, f"s{i:03d}", "hub", 1.0) for i in range(100)] + [(2, "hub", f"n{i:03d}", 1.0) for i in range(50)]
    led = ledger_of(edges)
    graph = adjacency.build_graph(led, str(tmp_path / "g"), parts=4)
    size = {}
    for n in (1, 100):
        seeds = ids_of([f"s{i:03d}" for i in range(n)])
        start = adjacency.seed_keys(graph, seeds)
        at = start.select(F.col("key").alias("id"), F.lit(None).cast("long").alias("parent"), F.array("key").alias("seeds"))
        one = strategy.materialize(adjacency.expand_shared(graph, at))
        # step back to each seed differs, so the frontier has a row a parent; merge what is equal but for it
        hub = one.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("seeds"))).alias("seeds"),
                                    F.lit(None).cast("long").alias("parent"))
        size[n] = adjacency.pairs_of(graph, hub).where("parent is null or b <> parent").count()
        got = adjacency.khop_shared(graph, seeds, 2)
        assert rows_of(got) == rows_of(khop(led, seeds, hops=2, require_labelled=False).select(*got.columns))
    assert size[1] == size[100] == 150


def test_second_hop_reads_pruned_parts_and_no_ledger(ledger_of, ids_of, tmp_path):
    led = ledger_of(random_edges())
    graph = adjacency.build_graph(led, str(tmp_path / "g"), parts=8)
    start = adjacency.seed_keys(graph, ids_of(["x001"]))
    at = strategy.materialize(start.select(F.col("key").alias("id"), F.lit(None).cast("long").alias("parent"),
                                           F.array("key").alias("seeds")))
    first = strategy.materialize(adjacency.expand_shared(graph, at))
    plan = plan_of(adjacency.expand_shared(graph, first))
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "timestamp" not in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan  # no ledger column
    assert "partial_min(a" in plan and "SortAggregate" not in plan  # the smallest parent by hash


def test_balls_from_the_graph(ledger_of, ids_of, tmp_path):
    led = ledger_of(random_edges(120, 60, 3))
    centres = ids_of(["x001", "x002", "x030", "absent"])
    graph = adjacency.build_graph(led, str(tmp_path / "g"), parts=4)
    balls = adjacency.grow_balls(graph, centres)
    want = explore.ball_levels(led, centres)
    keep = lambda df: rows_of(df.where("seed_id <> 'absent'"), "seed_id", "id")
    for n in (1, 2, 3, 4):
        # a centre that is not in the ledger has no members, where the scan keeps it in none either
        assert keep(balls.level(n)) == keep(want[n - 1])
    touching = explore.ball_edges(led, want[2]).where("source is not null and target is not null")
    assert rows_of(balls.edges()) == rows_of(touching)
    # each member of level 3 is expanded once
    expanded = [(s, r.a) for step in balls.steps for r in step.select("a", "seeds").distinct().collect() for s in r.seeds]
    members = sum(len(r.seeds) for r in balls.members[3].collect())
    assert len(expanded) == len(set(expanded)) == members
    n1 = explore.out_neighbours(led, centres.select(F.col("id").alias("seed_id"), "id"))
    degrees = rows_of(adjacency.out_degrees(balls), "seed_id", "from", "number")
    known = rows_of(explore.out_degree(led.where("`to` is not null"), n1), "seed_id", "from", "number")
    assert degrees == known


# --- hourly flows, transactions, days ---------------------------------------------

def test_cube_trends_equal_the_ledger(spark, ledger_of, tmp_path):
    rng = random.Random(1)
    led = ledger_of([(None if i % 50 == 0 else 900_000_000 + rng.randrange(86400 * 40), f"x{rng.randrange(9)}",
                      f"x{rng.randrange(9)}", rng.randrange(10_000) / 100) for i in range(800)])
    flagged = strategy.materialize(spark.createDataFrame(
        [("S", f"x{i}", i % 2 == 0) for i in range(6)] + [("T", "x1", True)],
        "seed_id string, id string, isInBlackListResult boolean"))
    c = cube.build_cube(led, str(tmp_path / "c"), 2, parts=4)
    keys = ("seed_id", "isInBlackListResult")
    for unit in flows.TREND_UNITS:
        want = flows.neighbour_trend(led, flagged, unit, "UTC", 2)
        got = cube.cube_trend(c, flows.tracked_accounts(flagged, keys), unit, keys, "UTC")
        assert rows_of(got.select(*want.columns)) == rows_of(want)
    hour = 900_000_000 // 3600 * 3600
    want = flows.recent_summary(led, flagged, hour, hour + 86400 * 9, amount_scale=2)
    assert rows_of(cube.cube_recent(c, flagged, hour, hour + 86400 * 9)) == rows_of(want)
    with pytest.raises(ValueError):
        cube.cube_recent(c, flagged, hour + 1, None)
    assert "value" not in plan_of(cube.cube_trend(c, flows.tracked_accounts(flagged, keys), "day", keys, "UTC"))


def test_touching_rows_are_stored_once_per_account(spark, ledger_of, tmp_path):
    led = ledger_of([(i, "hub", f"n{i}", 1.0) for i in range(30)] + [(99, "hub", "hub", 2.0)])
    accounts = strategy.materialize(spark.createDataFrame([(f"s{i}", "hub") for i in range(20)] + [("s1", "n3")],
                                                          "seed_id string, id string"))
    flows.store_touching(led, accounts, str(tmp_path / "t"), parts=4)
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 32 + 1
    got = flows.touching_transactions(spark, str(tmp_path / "t"), tz="UTC", typed=True)
    want = flows.transactions(led, accounts, "UTC", typed=True)
    assert dict(got.dtypes)["at"].startswith("timestamp")
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_a_window_opens_only_its_days(spark, ledger_of, tmp_path):
    led = ledger_of([(d * 86400 + i * 60, "a", "b", 1.0) for d in range(60) for i in range(5)] + [(None, "a", "b", 1.0)])
    clean.write_daily_ledger(led, str(tmp_path / "d"))
    month = clean.read_daily_ledger(spark, str(tmp_path / "d"), 30 * 86400, 40 * 86400 + 61)
    assert month.count() == 52 and "PartitionFilters: [isnotnull(day" in plan_of(month)
    scan = month.select("_metadata.file_path").distinct().count()
    assert scan == 11 < len(spark.read.parquet(str(tmp_path / "d")).inputFiles())


# --- sample, sums, sieve ------------------------------------------------------------

def test_equal_rows_are_sampled_one_by_one(ledger_of, spark):
    led = ledger_of([(1, "a", "b", 1.0)] * 10_000)
    got = explore.sample_rows(led, 0.5, method="hash").count()
    assert 4_700 < got < 5_300
    assert explore.sample_rows(led.repartition(7), 0.5, method="hash").count() == got


def test_exact_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(2)
    values = [1e18, 1e-9, -1e18, 3.5, -0.1, 1e300, -1e300, 5e-324, 2.0 ** -1022, 0.0, 1.7e308, -1.7e308]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-30, 30) for _ in range(400)]
    want = float(sum(Fraction(v) for v in values))
    for parts in (1, 5, 13):
        rng.shuffle(values)
        df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, value double").repartition(parts)
        r = exact_sum(df, ["k"]).first()
        if parts == 1:
            first = r.total_amount
        assert r.total_amount == first and r["count"] == len(values) + 1
        assert first == pytest.approx(want, rel=1e-15)
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("n", nan), ("n", 1.0), ("u", inf), ("u", 1.0), ("d", -inf), ("b", inf), ("b", -inf),
                                ("e", None), ("t", 1e18), ("t", 1e-9), ("t", -1e18)], "k string, value double")
    got = {r.k: r.total_amount for r in exact_sum(df, ["k"]).collect()}
    assert got["n"] != got["n"] and got["b"] != got["b"]
    assert (got["u"], got["d"], got["e"], got["t"]) == (inf, -inf, None, 1e-9)


def test_sieve_stops_rows_before_the_shuffle(spark):
    big = spark.range(100_000).select(F.concat(F.lit("a"), "id").alias("id"))
    small = spark.createDataFrame([(f"a{i}",) for i in range(0, 1000, 10)], "id string")
    left = strategy.sieved(big, small, ["id"])
    assert 100 <= left.count() <= 110
    assert strategy.shuffle_join(big, small, ["id"]).count() == 100


# --- stages and completion ------------------------------------------------------------

def study_inputs(ledger_of, ids_of):
    led = ledger_of(random_edges(200, 30, 5))
    return led, ids_of([f"x{i:03d}" for i in range(4)]), ids_of(["x000", "x001", "x002", "x003"], "account"), \
        ids_of(["x004", "x005"], "blacklist")


def contents(spark, out):
    got = {}
    for name in sorted(os.listdir(out)):
        if not name.endswith(".commits"):
            df = spark.read.parquet(f"{out}/{name}")
            keep = sinks.read_committed(spark, f"{out}/{name}", df.drop("attempt").schema, ["seed_id"])
            got[name] = rows_of(keep.drop("attempt"))
    return got


def test_a_half_written_output_is_ignored_and_written_again(spark, ledger_of, ids_of, tmp_path):
    inputs = study_inputs(ledger_of, ids_of)
    cfg = StudyConfig(hops=2, amount_scale=2, tz="UTC", mode="missing")
    clean_run, lost_run = str(tmp_path / "clean"), str(tmp_path / "lost")
    run_study(*inputs, clean_run, cfg)
    # a job that died: some rows of one output under its attempt, no record of it
    rows = spark.read.parquet(f"{clean_run}/neighbour_transactions").drop("attempt")
    rows.limit(3).write.partitionBy("seed_id", "id").parquet(f"{lost_run}/neighbour_transactions/attempt=dead")
    run_study(*inputs, lost_run, cfg)
    assert contents(spark, lost_run) == contents(spark, clean_run)
    before = contents(spark, lost_run)
    run_study(*inputs, lost_run, cfg)  # nothing is pending
    assert contents(spark, lost_run) == before


def test_stages_are_reused_after_a_failure_and_removed_at_the_end(spark, tmp_path):
    made = []

    def job(fail):
        with stages.StageStore(spark, {"in": 1}, str(tmp_path)) as store:
            made.append(store)
            a = strategy.materialize(spark.range(5), name="hop")
            b = strategy.materialize(a.where("id > 1"), name="hop")
            if fail:
                raise RuntimeError("lost")
            return b.count()

    with pytest.raises(RuntimeError):
        job(True)
    assert len(os.listdir(tmp_path)) == 1
    assert job(False) == 3 and made[-1].reused == 2
    assert os.listdir(tmp_path) == []


# --- the year's ledger, seconds of a wall clock, amounts of the cube -----------------

def test_the_stored_ledger_is_the_year_alone(spark, tmp_path):
    year = fx.YEAR_START // 86400
    days = [year - 1, year, year + 100, year + 364, year + 365, None]
    lines = [(o, p, disc, 10.0 * o if o else None, d) for o in (1, 2, 2, 23, None) for p, disc in ((5, 0.1), (6, 0.0), (None, 0.1)) for d in days]
    (spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double, l_extendedprice double, d int")
     .withColumn("l_shipdate", F.expr("cast(date_add(date'1970-01-01', d) as timestamp_ntz)")).drop("d")
     .write.parquet(str(tmp_path / "lineitem.parquet")))
    spark.createDataFrame([(1, 7), (2, None), (2, 8), (23, 9), (None, 9)], "o_orderkey long, o_custkey long").write.parquet(
        str(tmp_path / "orders.parquet"))
    d = str(tmp_path)
    year_rows = rows_of(fx.graph_edges(spark, d, stored=False))
    assert rows_of(fx.graph_edges(spark, d)) == year_rows and len(year_rows) > 50
    assert rows_of(fx.ledger(spark, d)) == rows_of(fx.ledger(spark, d, stored=False))
    assert fx.ledger_table(spark, d).count() == len(year_rows) < fx.ledger_raw(spark, d).count()
    # the window stands below the join, and keys travel as longs
    plan = fx.time_window(fx.ledger_raw(spark, d), fx.YEAR_START, fx.YEAR_END)._jdf.queryExecution().optimizedPlan().toString()
    join, lines_side = plan.index("Join Inner"), plan[plan.index("Join Inner"):]
    assert str(fx.YEAR_START) in lines_side and "concat" in plan[:join] and "concat" not in lines_side


def test_seconds_of_a_wall_clock(spark):
    at = ["1997-09-01 13:14:15.75", "1970-01-01 00:00:00", "1969-12-31 23:59:58.25", "1900-02-28 01:02:03", None]
    want = [873119655, 0, -2, -2203973877, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(at)], "i int, s string").selectExpr("i", "cast(s as timestamp_ntz) as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            seconds = timestamp_to_epoch(df, "t")
            assert [r.s for r in df.select("i", seconds.alias("s")).orderBy("i").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # from 1970 on no calendar fields are taken apart
    assert "unix_timestamp" in seconds._jc.toString()


def test_cube_makes_hour_and_amount_once_per_transfer(spark, ledger_of):
    led = ledger_of([(7200, "a", "b", 1.5), (7201, "a", None, 2.25), (7300, None, None, float("nan")), (None, "a", "b", 4.0),
                     (10900, "a", "a", None)])
    got = cube.hourly(led, 2)
    assert rows_of(got.selectExpr("id", "direction", "hour", "cast(total as string)", "count")) == sorted(
        [("a", "from", 7200, "3.75", 2), ("b", "to", 7200, "1.50", 1), ("a", "from", 10800, None, 1), ("a", "to", 10800, None, 1)], key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as decimal(38,2)") == 1 and plan.index("Generate") < plan.index("as decimal(38,2)")


def test_stored_tables_are_not_sorted_inside_a_part(spark, ledger_of, tmp_path):
    led = ledger_of([(i * 3600, f"x{i * 7 % 40}", f"x{i % 11}", 1.0) for i in range(400)])
    seen = []
    sort = type(led).sortWithinPartitions
    try:
        type(led).sortWithinPartitions = lambda self, *c, **k: seen.append(c) or sort(self, *c, **k)
        graph = adjacency.build_graph(led, str(tmp_path / "g"))
        cube.build_cube(led, str(tmp_path / "c"), 2)
    finally:
        type(led).sortWithinPartitions = sort
    assert not seen and graph.parts == 1
    assert [r.id for r in graph.accounts.orderBy("key").collect()] == sorted({f"x{i}" for i in range(40)})
