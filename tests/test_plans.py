"""Plan shapes that the scale design relies on (checked on sf0.001)."""

from __future__ import annotations

import contextlib
import io
import os

import pytest

from hoplens.operators import expand, flows, labels
from hoplens.plans.strategy import materialize
from hoplens.sources import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_hop_plan_shape(spark):
    led = fx.ledger(spark, SF_DIR)
    seeds = fx.seeds(spark, SF_DIR)
    frontier = materialize(expand.seed_frontier(seeds))
    plan = _plan(expand.expand_hop(led, frontier, 30, frontier_bound=6))
    # the frontier is broadcast; the ledger is never shuffled by the join
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # time window and zero filter reach the scan; only needed columns are read
    assert "PushedFilters: [IsNotNull(timestamp), IsNotNull(value), GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:bigint,from:string,to:string,value:double>" in plan
    # the per-seed cap runs partially before its exchange
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # multi-edges collapse map-side before the first exchange
    assert "partial_min" in plan


def test_recent_window_pushdown(spark):
    led = fx.ledger(spark, SF_DIR)
    flagged = spark.createDataFrame([("a1", "a2", True)],
                                    "seed_id string, id string, isInBlackListResult boolean")
    plan = _plan(flows.recent_summary(led, flagged, fx.RECENT_START, fx.RECENT_END))
    assert f"GreaterThanOrEqual(timestamp,{fx.RECENT_START})" in plan
    assert "partial_count" in plan or "partial_sum" in plan


def test_flag_streams_blacklist_through_semi_join(spark):
    n = spark.createDataFrame([("a1", "a2", "a1", 1)],
                              "seed_id string, id string, originalAddress string, label int")
    plan = _plan(labels.flag(n, fx.blacklist(spark, SF_DIR)))
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
