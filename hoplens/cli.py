"""Command line for the four jobs: clean, study, ratio, explore.

    python -m hoplens.cli clean   --raw RAW --out LEDGER [--start S --end E]
    python -m hoplens.cli study   --ledger LEDGER --seeds SEEDS --labelled L --blacklist B --out DIR
    python -m hoplens.cli ratio   --ledger LEDGER --seeds SEEDS --labelled L --blacklist B --out DIR
    python -m hoplens.cli explore --graph RAW --seeds SEEDS --labelled L --blacklist B --out DIR

``clean`` and ``explore`` window to the original study's year by default,
``study`` takes its recent window from the last month of it
(``hoplens.functions.time.STUDY_YEAR`` / ``STUDY_LAST_MONTH``); ``study`` and
``ratio`` read a ledger already cleaned and do not re-window unless asked.
Paths may use any Hadoop scheme (``hdfs://``, ``file://``, object stores).
Ledgers are Parquet unless ``--ledger-format csv``; account lists are header
CSV files (``account`` for labelled, ``blacklist`` for the blacklist; seeds
come from ``blacklist``, ``account`` or ``id``, the first that the file has, so
a blacklist serves as the seed list). ``explore`` takes each seed's star from
a column ``role`` of the seed file (``two_way``, ``out`` or ``sampled``);
without that column every seed has all three. The session and its settings
come from ``spark-submit``/defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hoplens.functions.time import STUDY_LAST_MONTH, STUDY_YEAR
from hoplens.operators.clean import clean_ledger, time_window, write_clean_ledger
from hoplens.plans.pipeline import (StudyConfig, explore_study, ratio_study, run_study,
                                    write_all)
from hoplens.sources.ledger import RAW_LEDGER_SCHEMA, account_ids, read_accounts, read_ledger


def _caps(text: str | None):
    if text is None or text.lower() == "none":
        return None
    return tuple(int(x) if x.lower() != "none" else None for x in text.split(","))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hoplens")
    sub = p.add_subparsers(dest="job", required=True)

    def common(sp, ledger_arg="--ledger", window=(None, None)):
        sp.add_argument(ledger_arg, required=True)
        sp.add_argument("--ledger-format", default="parquet")
        sp.add_argument("--seeds", required=True)
        sp.add_argument("--labelled")
        sp.add_argument("--blacklist", required=True)
        sp.add_argument("--out", required=True)
        sp.add_argument("--mode", default="errorifexists")
        sp.add_argument("--format", default="parquet")
        sp.add_argument("--start", type=int, default=window[0])
        sp.add_argument("--end", type=int, default=window[1])

    c = sub.add_parser("clean", help="window the raw ledger and drop zero-value rows")
    c.add_argument("--raw", required=True)
    c.add_argument("--raw-format", default="csv")
    c.add_argument("--out", required=True)
    c.add_argument("--start", type=int, default=STUDY_YEAR[0])
    c.add_argument("--end", type=int, default=STUDY_YEAR[1])
    c.add_argument("--mode", default="errorifexists")
    c.add_argument("--format", default="parquet", choices=("parquet", "orc", "csv"))

    s = sub.add_parser("study", help="k-hop neighbourhood, flags, transactions, trends")
    common(s)
    s.add_argument("--hops", type=int, default=4)
    s.add_argument("--caps", help="per-hop caps, e.g. 30,25,20,10; none by default")
    s.add_argument("--recent-start", type=int, default=STUDY_LAST_MONTH[0])
    s.add_argument("--recent-end", type=int, default=STUDY_LAST_MONTH[1])
    s.add_argument("--tz")
    s.add_argument("--amount-scale", type=int)

    r = sub.add_parser("ratio", help="share of blacklisted accounts among hop-2 neighbours")
    common(r)

    e = sub.add_parser("explore", help="star and ball subgraphs around the seeds")
    common(e, "--graph", STUDY_YEAR)  # the prototype windows the raw export
    e.add_argument("--fraction", type=float, help="part of the sampled star's edges; required where a seed is sampled "
                   "(role 'sampled', or no role column)")
    e.add_argument("--sample-method", default="hash")
    return p


def main(argv=None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"hoplens-{args.job}").getOrCreate()
    if args.job == "clean":
        schema = RAW_LEDGER_SCHEMA if args.raw_format == "csv" else None
        raw = read_ledger(spark, args.raw, args.raw_format, schema)
        write_clean_ledger(clean_ledger(raw, args.start, args.end), args.out, args.mode, args.format)
        return
    fmt = args.ledger_format
    src = args.graph if args.job == "explore" else args.ledger
    schema = RAW_LEDGER_SCHEMA if fmt == "csv" else None
    ledger = read_ledger(spark, src, fmt, schema)
    seeds = read_accounts(spark, args.seeds)
    labelled = read_accounts(spark, args.labelled, "account") if args.labelled else None
    blacklist = read_accounts(spark, args.blacklist, "blacklist")
    if args.job == "study":
        cfg = StudyConfig(hops=args.hops, caps=_caps(args.caps), recent_start=args.recent_start,
                          recent_end=args.recent_end, tz=args.tz, amount_scale=args.amount_scale,
                          fmt=args.format, mode=args.mode)
        run_study(clean_ledger(ledger, args.start, args.end), seeds, labelled, blacklist,
                  args.out, cfg)
    elif args.job == "ratio":
        outs = ratio_study(clean_ledger(ledger, args.start, args.end), seeds, labelled, blacklist)
        write_all(outs, args.out, args.format, args.mode)
    else:
        graph = time_window(ledger, args.start, args.end)
        listed = spark.read.option("header", True).csv(args.seeds)
        role = [account_ids(listed.where(F.col("role") == r)) if "role" in listed.columns else seeds
                for r in ("two_way", "out", "sampled")]
        if args.fraction is None and not role[2].isEmpty():
            parser.error("--fraction is required: some seeds' stars are sampled")
        fraction = 1.0 if args.fraction is None else args.fraction  # without sampled seeds it thins nothing
        outs = explore_study(graph, role[0], role[1], role[2], seeds, labelled, blacklist,
                             fraction, args.sample_method)
        write_all(outs, args.out, args.format, args.mode)


if __name__ == "__main__":
    main()
