"""The shuffle-join fallbacks (no broadcast allowed) give the broadcast results."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hoplens.operators import explore, flows
from hoplens.operators.expand import khop
from hoplens.operators.labels import flag, label_set
from hoplens.sources import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_broadcast_paths_match(spark, no_auto_broadcast):
    led = fx.ledger(spark, SF_DIR)
    graph = fx.graph_edges(spark, SF_DIR)
    seeds = fx.seeds(spark, SF_DIR)
    labels = label_set(fx.labelled(spark, SF_DIR), fx.blacklist(spark, SF_DIR))
    black = fx.blacklist(spark, SF_DIR)
    for caps in ((30, 25, 20, 10), None):
        a = khop(led, seeds, labels=labels, hops=3, caps=caps)
        b = khop(led, seeds, labels=labels, hops=3, caps=caps, max_broadcast_rows=0)
        assert _rows(a) == _rows(b)
    from hoplens.operators.expand import expand_hop, seed_frontier
    hop = expand_hop(led, seed_frontier(seeds), 30, max_broadcast_rows=0)
    plan = hop._jdf.queryExecution().executedPlan().toString()
    # only the sieve's bit table is broadcast, the frontier is not
    assert "SortMergeJoin" in plan
    assert all("_cell" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    n = khop(led, seeds, labels=labels)
    fa, fb = flag(n, black), flag(n, black, max_broadcast_rows=0)
    assert _rows(fa) == _rows(fb)
    acc = flows.tracked_accounts(fa, ("seed_id", "isInBlackListResult"))
    ta = flows.account_flows(led, acc)
    tb = flows.account_flows(led, acc, max_broadcast_rows=0)
    assert _rows(ta) == _rows(tb)
    centres = seeds.select(F.col("id").alias("seed_id"), "id")
    ga = explore.grow(graph, centres)
    gb = explore.grow(graph, centres, max_broadcast_rows=0)
    assert _rows(ga) == _rows(gb)
    ca = explore.component_labelled(fx.components(spark, SF_DIR), labels, graph)
    cb = explore.component_labelled(fx.components(spark, SF_DIR), labels, graph,
                                    max_broadcast_rows=0)
    assert _rows(ca) == _rows(cb)


@pytest.fixture
def no_aqe(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_salted_paths_match(spark, no_auto_broadcast, no_aqe):
    from hoplens.operators.expand import expand_hop, seed_frontier
    from hoplens.plans.strategy import aqe_splits_skew

    assert not aqe_splits_skew(spark)
    led = fx.ledger(spark, SF_DIR)
    graph = fx.graph_edges(spark, SF_DIR)
    seeds = fx.seeds(spark, SF_DIR)
    labels = label_set(fx.labelled(spark, SF_DIR), fx.blacklist(spark, SF_DIR))
    hop = expand_hop(led, seed_frontier(seeds), None, max_broadcast_rows=0)
    assert "_salt" in hop._jdf.queryExecution().executedPlan().toString()
    for caps in ((30, 25, 20, 10), None):
        a = khop(led, seeds, labels=labels, hops=3, caps=caps)
        b = khop(led, seeds, labels=labels, hops=3, caps=caps, max_broadcast_rows=0)
        assert _rows(a) == _rows(b)
    n = khop(led, seeds, labels=labels)
    acc = flows.tracked_accounts(flag(n, fx.blacklist(spark, SF_DIR)), ("seed_id",))
    assert _rows(flows.account_flows(led, acc)) == _rows(
        flows.account_flows(led, acc, max_broadcast_rows=0))
    comps = fx.components(spark, SF_DIR)
    assert _rows(explore.component_labelled(comps, labels, graph)) == _rows(
        explore.component_labelled(comps, labels, graph, max_broadcast_rows=0))
