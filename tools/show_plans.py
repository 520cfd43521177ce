"""Print the physical plans of the key operators (``explain("formatted")``).

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""
from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hoplens.operators import expand, explore, flows, labels  # noqa: E402
from hoplens.plans import catalog  # noqa: E402
from hoplens.plans.strategy import materialize  # noqa: E402
from hoplens.session import build_session  # noqa: E402
from hoplens.sources import fixtures as fx  # noqa: E402


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    # drop machine-specific folders from the plan text
    return "\n".join(line for line in text.splitlines() if not line.startswith("Location:"))


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    led = fx.ledger(spark, d)
    seeds = fx.seeds(spark, d)
    labs = catalog._labels(spark, d)
    frontier = materialize(expand.seed_frontier(labels.gate_seeds(seeds, labs)))
    hop1 = materialize(expand.expand_hop(led, frontier, 30, frontier_bound=6))
    flagged = catalog._flagged(spark, d)
    sections = [
        ("One capped hop (hop 2 from the stored hop-1 frontier)",
         expand.expand_hop(led, hop1, 25, frontier_bound=6 * 30)),
        ("Blacklist flag of the neighbourhood", labels.flag(expand.khop(led, seeds, labels=labs),
                                                            fx.blacklist(spark, d))),
        ("Daily trend of flagged neighbours",
         flows.neighbour_trend(led, flagged, "day", "UTC", 2)),
        ("Recent-window totals (time filter pushed into the scan)",
         flows.recent_summary(led, flagged, fx.RECENT_START, fx.RECENT_END, seeds, 2)),
        ("Ball growth step", explore.grow(fx.graph_edges(spark, d),
                                          seeds.select(F.col("id").alias("seed_id"), "id"))),
    ]
    print("# Physical plans of the key operators\n")
    print(f"Generated by `python tools/show_plans.py {d}` (local[8], AQE on; the plans are")
    print("shown before AQE's run-time re-planning).\n")
    for title, df in sections:
        print(f"## {title}\n\n```\n{formatted(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
