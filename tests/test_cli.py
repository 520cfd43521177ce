"""The four jobs through the command line, on small CSV inputs."""

from __future__ import annotations

import os
import tempfile

import pytest

from hoplens.cli import main
from hoplens.sources.ledger import RAW_LEDGER_SCHEMA

HEADER = ",".join(f.name for f in RAW_LEDGER_SCHEMA.fields)
ROWS = [(10, "S", "A", 1.0), (20, "A", "B", 2.0), (30, "B", "C", 0.0), (40, "C", "S", 4.0),
        (50, "T", "A", 5.0), (60, "A", "A", 6.0), (999, "S", "Z", 1.0)]


OUTPUTS = ("neighbours", "neighbours_flagged", "seed_transactions", "neighbour_transactions",
           "recent_summary", "blacklist_ratio", "trend_day", "trend_hour", "seed_report")


def _rows(spark, path):
    df = spark.read.parquet(path).drop("attempt")
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_cli_jobs(spark):
    d = tempfile.mkdtemp(prefix="hoplens-cli-")
    _write(f"{d}/raw.csv", HEADER + "\n" + "\n".join(
        f"{t},{a},{b},ETH,{v},0x{t},1,2,0.1,eoa,eoa,call,0,1" for t, a, b, v in ROWS) + "\n")
    _write(f"{d}/seeds.csv", "id\nS\nT\n")
    _write(f"{d}/labelled.csv", "id,account\n1,S\n")
    _write(f"{d}/black.csv", "id,blacklist\n1,B\n2,B\n")
    main(["clean", "--raw", f"{d}/raw.csv", "--out", f"{d}/ledger", "--start", "0", "--end", "100"])
    ledger = spark.read.parquet(f"{d}/ledger")
    assert ledger.count() == 5  # zero value and out-of-window rows dropped
    acc = ["--seeds", f"{d}/seeds.csv", "--labelled", f"{d}/labelled.csv",
           "--blacklist", f"{d}/black.csv"]
    main(["study", "--ledger", f"{d}/ledger", *acc, "--out", f"{d}/study", "--caps", "2,2,2,2",
          "--tz", "UTC", "--recent-start", "0", "--recent-end", "100"])
    report = {r.seed_id: r for r in spark.read.parquet(f"{d}/study/seed_report").collect()}
    assert report["T"].neighbour_count == 0 and report["S"].hop1_count == 2
    assert os.path.isdir(f"{d}/study/neighbour_transactions/seed_id=S")
    main(["ratio", "--ledger", f"{d}/ledger", *acc, "--out", f"{d}/ratio"])
    ratio = {r.seed_id: r for r in spark.read.parquet(f"{d}/ratio/blacklist_ratio").collect()}
    assert ratio["S"].black_count == 1 and ratio["T"].ratio is None
    main(["explore", "--graph", f"{d}/raw.csv", "--ledger-format", "csv", *acc,
          "--out", f"{d}/explore", "--start", "0", "--end", "100", "--fraction", "1.0"])
    ids = sorted(r.id for r in spark.read.parquet(f"{d}/explore/star_vertices").collect())
    assert ids == ["A", "C", "S"]  # S is labelled; T is not, so it has no star
    assert spark.read.parquet(f"{d}/explore/ball4").where("seed_id = 'T'").isEmpty()
    percent = {r.seed_id: r.percent for r in spark.read.parquet(f"{d}/ratio/blacklist_percent").collect()}
    assert percent["S"].endswith("%") and percent["T"] is None
    _write(f"{d}/roles.csv", "id,role\nS,out\nB,two_way\n")
    main(["explore", "--graph", f"{d}/raw.csv", "--ledger-format", "csv", "--seeds", f"{d}/roles.csv",
          *acc[2:], "--out", f"{d}/roles", "--start", "0", "--end", "100", "--fraction", "1.0"])
    stars = {(r["from"], r["to"]) for r in spark.read.parquet(f"{d}/roles/star_edges").collect()}
    assert stars == {("S", "A"), ("A", "B"), ("B", "C")}  # out-star of S, two-way star of B
    assert spark.read.parquet(f"{d}/roles/star_sampled").isEmpty()


def test_explore_samples_only_with_a_fraction(spark, capsys):
    d = tempfile.mkdtemp(prefix="hoplens-cli-")
    _write(f"{d}/raw.csv", HEADER + "\n" + "\n".join(
        f"{t},{a},{b},ETH,{v},0x{t},1,2,0.1,eoa,eoa,call,0,1" for t, a, b, v in ROWS) + "\n")
    _write(f"{d}/black.csv", "id,blacklist\n1,B\n2,S\n")
    _write(f"{d}/roles.csv", "id,role\nS,sampled\nB,two_way\n")
    for seeds in ("black", "roles"):
        with pytest.raises(SystemExit):
            main(["explore", "--graph", f"{d}/raw.csv", "--ledger-format", "csv", "--seeds", f"{d}/{seeds}.csv",
                  "--blacklist", f"{d}/black.csv", "--out", f"{d}/{seeds}", "--start", "0", "--end", "100"])
        assert "--fraction is required" in capsys.readouterr().err and not os.path.exists(f"{d}/{seeds}")


def test_csv_ledger_gives_the_study_of_the_parquet_ledger(spark):
    d = tempfile.mkdtemp(prefix="hoplens-cli-")
    _write(f"{d}/raw.csv", HEADER + "\n" + "\n".join(
        f"{t},{a},{b},ETH,{v},0x{t},1,2,0.1,eoa,eoa,call,0,1" for t, a, b, v in ROWS) + "\n")
    _write(f"{d}/black.csv", "id,blacklist\n1,B\n2,S\n")
    got = {}
    for fmt in ("csv", "parquet"):
        main(["clean", "--raw", f"{d}/raw.csv", "--out", f"{d}/{fmt}", "--format", fmt,
              "--start", "0", "--end", "100"])
        main(["study", "--ledger", f"{d}/{fmt}", "--ledger-format", fmt, "--seeds", f"{d}/black.csv",
              "--blacklist", f"{d}/black.csv", "--out", f"{d}/out-{fmt}", "--tz", "UTC",
              "--recent-start", "0", "--recent-end", "100"])
        got[fmt] = [_rows(spark, f"{d}/out-{fmt}/{n}") for n in OUTPUTS]
    assert got["csv"] == got["parquet"]
    assert {r[-1] for r in got["csv"][0]} and len(got["csv"][OUTPUTS.index("seed_report")]) == 2


def test_a_second_seed_list_is_added_to_every_output(spark):
    d = tempfile.mkdtemp(prefix="hoplens-cli-")
    _write(f"{d}/raw.csv", HEADER + "\n" + "\n".join(
        f"{t},{a},{b},ETH,{v},0x{t},1,2,0.1,eoa,eoa,call,0,1" for t, a, b, v in ROWS) + "\n")
    _write(f"{d}/black.csv", "id,blacklist\n1,B\n2,S\n")
    _write(f"{d}/one.csv", "id\nS\n")
    _write(f"{d}/both.csv", "id\nS\nB\n")
    main(["clean", "--raw", f"{d}/raw.csv", "--out", f"{d}/ledger", "--start", "0", "--end", "100"])
    for seeds, out in (("one", "steps"), ("both", "steps"), ("both", "once")):
        main(["study", "--ledger", f"{d}/ledger", "--seeds", f"{d}/{seeds}.csv", "--blacklist",
              f"{d}/black.csv", "--out", f"{d}/{out}", "--mode", "missing", "--tz", "UTC",
              "--recent-start", "0", "--recent-end", "100"])
    for name in OUTPUTS:
        assert _rows(spark, f"{d}/steps/{name}") == _rows(spark, f"{d}/once/{name}"), name


def test_study_rerun_with_missing_mode_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="hoplens-cli-")
    _write(f"{d}/raw.csv", HEADER + "\n" + "\n".join(
        f"{t},{a},{b},ETH,{v},0x{t},1,2,0.1,eoa,eoa,call,0,1" for t, a, b, v in ROWS) + "\n")
    _write(f"{d}/seeds.csv", "id\nS\nT\n")
    _write(f"{d}/black.csv", "id,blacklist\n1,B\n1,S\n")
    main(["clean", "--raw", f"{d}/raw.csv", "--out", f"{d}/ledger", "--start", "0", "--end", "100"])
    args = ["study", "--ledger", f"{d}/ledger", "--seeds", f"{d}/seeds.csv",
            "--blacklist", f"{d}/black.csv", "--out", f"{d}/study", "--mode", "missing",
            "--recent-start", "0", "--recent-end", "100"]
    main(args)
    first = {n: spark.read.parquet(f"{d}/study/{n}").count()
             for n in ("neighbour_transactions", "neighbours", "seed_report", "trend_day")}
    main(args)  # a rerun writes only what is missing: nothing
    again = {n: spark.read.parquet(f"{d}/study/{n}").count() for n in first}
    assert first == again and first["neighbour_transactions"] > 0
