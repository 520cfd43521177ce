"""The study's outputs equal the oracle-checked registered queries (sf0.001)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from hoplens.plans.pipeline import StudyConfig, neighbourhood_study, ratio_study
from hoplens.sources import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")

SAME = {
    "neighbours": "khop4_uncapped",
    "neighbours_flagged": "neighbours_flagged",
    "recent_summary": "recent_summary",
    "seed_report": "seed_report",
    "trend_day": "trend_daily",
    "trend_hour": "trend_hourly",
    "trend_month": "trend_monthly",
    "neighbour_transactions": "neighbour_transactions",
}


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_study_matches_registered_queries(spark):
    cfg = StudyConfig(recent_start=fx.RECENT_START, recent_end=fx.RECENT_END, tz="UTC",
                      amount_scale=2, units=("day", "hour", "month"))
    outs = neighbourhood_study(fx.ledger(spark, SF_DIR), fx.seeds(spark, SF_DIR),
                               fx.labelled(spark, SF_DIR), fx.blacklist(spark, SF_DIR), cfg)
    qs = entry.queries()
    for out_name, query in SAME.items():
        assert _rows(outs[out_name]) == _rows(qs[query](spark, SF_DIR)), out_name
    seed_tx = outs["seed_transactions"].drop("id")
    assert _rows(seed_tx) == _rows(qs["account_transactions"](spark, SF_DIR))


def test_ratio_study_matches_registered_query(spark):
    outs = ratio_study(fx.ledger(spark, SF_DIR), fx.seeds(spark, SF_DIR),
                       fx.labelled(spark, SF_DIR), fx.blacklist(spark, SF_DIR))
    assert _rows(outs["blacklist_ratio"]) == _rows(entry.queries()["blacklist_ratio"](spark, SF_DIR))
