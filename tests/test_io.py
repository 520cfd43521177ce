"""Readers, sinks and the end-to-end study."""

from __future__ import annotations

import os
import tempfile

import pytest

from hoplens.operators.clean import write_clean_ledger
from hoplens.plans.pipeline import StudyConfig, neighbourhood_study, run_study
from hoplens.sources.ledger import RAW_LEDGER_SCHEMA, read_accounts, read_ledger

RAW_HEADER = ",".join(f.name for f in RAW_LEDGER_SCHEMA.fields)


def _raw_line(ts, a, b, v):
    return f"{ts},{a},{b},ETH,{v},0xh{ts},1.0,2.0,0.1,eoa,eoa,call,0,1"


def _scratch():
    return tempfile.mkdtemp(prefix="hoplens-test-")


def test_read_raw_csv_and_accounts(spark):
    d = _scratch()
    with open(os.path.join(d, "ledger.csv"), "w") as f:
        f.write(RAW_HEADER + "\n" + _raw_line(5, "A", "B", 1.5) + "\n" + _raw_line(6, "B", "C", 0.0) + "\n")
    with open(os.path.join(d, "black.csv"), "w") as f:
        f.write("id,blacklist\n1,B\n2,B\n")
    led = read_ledger(spark, os.path.join(d, "ledger.csv"), "csv", RAW_LEDGER_SCHEMA)
    assert led.count() == 2 and dict(led.dtypes)["timestamp"] == "bigint"
    bl = read_accounts(spark, os.path.join(d, "black.csv"))
    assert bl.columns == ["id"] and sorted(r.id for r in bl.collect()) == ["B", "B"]


def test_store_and_read_clean_ledger(spark, ledger_of):
    d = _scratch()
    led = ledger_of([(3, "A", "B", 1.0), (1, "B", "C", 2.0)])
    write_clean_ledger(led, d + "/ledger")
    back = read_ledger(spark, d + "/ledger")
    assert sorted(r.timestamp for r in back.collect()) == [1, 3]


def test_study_writes_partitioned_outputs(spark, ledger_of, ids_of):
    led = ledger_of([(1, "S", "A", 1.0), (2, "A", "B", 2.0), (3, "B", "C", 3.0),
                     (4, "C", "S", 4.0), (5, "T", "Z", 1.0)])
    seeds, labelled, black = ids_of(["S", "T"]), ids_of(["S"], "account"), ids_of(["B"], "blacklist")
    cfg = StudyConfig(caps=(2, 2, 2, 2), recent_start=0, recent_end=10, tz="UTC", amount_scale=2)
    outs = neighbourhood_study(led, seeds, labelled, black, cfg)
    rep = {r.seed_id: r for r in outs["seed_report"].collect()}
    assert rep["T"].neighbour_count == 0  # gated out
    assert rep["S"].black_count >= 1
    d = _scratch()
    paths = run_study(led, seeds, labelled, black, d + "/out", cfg)
    assert os.path.isdir(os.path.join(paths["neighbour_transactions"], "seed_id=S"))
    assert spark.read.parquet(paths["trend_day"]).count() > 0


def test_write_missing_appends_only_new_partitions(spark):
    from hoplens.plans.sinks import write_table

    d = _scratch() + "/tx"
    first = spark.createDataFrame([("S", "A", 1), ("S", "0001", 2)], "seed_id string, id string, v int")
    write_table(first, d, mode="missing", partition_by=("seed_id", "id"))
    again = spark.createDataFrame([("S", "A", 99), ("S", "0001", 98), ("S", "C", 3)], "seed_id string, id string, v int")
    write_table(again, d, mode="missing", partition_by=("seed_id", "id"))
    got = sorted((r.id, r.v) for r in spark.read.parquet(d).collect())
    assert got == [("0001", 2), ("A", 1), ("C", 3)]  # A kept, only C added


def test_read_csv_inferred(spark):
    d = _scratch()
    with open(os.path.join(d, "clean.csv"), "w") as f:
        f.write("timestamp,from,to,value\n5,A,B,1.5\n6,B,C,2\n")
    led = read_ledger(spark, os.path.join(d, "clean.csv"), "csv", infer_schema=True)
    types = dict(led.dtypes)
    assert types["timestamp"] == "bigint" and types["value"] == "double"


def test_csv_columns_go_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(5, "A", "B", 1.5), (6, "B", "C", 2.0)],
                                 "timestamp long, from string, to string, value double")
    rows.write.option("header", True).csv(str(tmp_path / "clean"))
    names = ["timestamp", "from", "to", "value"]
    got = read_ledger(spark, str(tmp_path / "clean"), "csv", RAW_LEDGER_SCHEMA).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    rows.drop("value").write.option("header", True).csv(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="value"):
        read_ledger(spark, str(tmp_path / "short"), "csv", RAW_LEDGER_SCHEMA)
