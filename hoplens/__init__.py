"""hoplens — neighbourhood analytics on transfer ledgers, built on Spark.

Given a ledger of timestamped transfers between accounts, seed accounts and a
blacklist: clean and window the ledger, expand every seed to its neighbours
hop by hop, flag blacklisted neighbours and their share, collect the
transactions of seeds and neighbours, and report flow trends, recent totals
and star / ball subgraphs. Every operator takes and returns DataFrames and
runs all seeds in one plan (``seed_id`` is a key column).
"""

from hoplens.operators.clean import clean_ledger, time_window, write_clean_ledger
from hoplens.operators.expand import DEFAULT_CAPS, expand_hop, hop, hop_pairs, khop
from hoplens.operators.flows import (account_flows, account_trend, neighbour_account_trend,
                                     neighbour_trend, recent_summary, transactions, trend,
                                     trends)
from hoplens.plans.pipeline import (StudyConfig, explore_study, neighbourhood_study,
                                    ratio_study, run_study)
from hoplens.operators.labels import (black_neighbours, blacklist_ratio, flag, gate_seeds,
                                      label_set)
from hoplens.operators.report import seed_report
from hoplens.sources.ledger import read_accounts, read_ledger

__all__ = [
    "DEFAULT_CAPS", "StudyConfig", "account_flows", "account_trend", "black_neighbours",
    "blacklist_ratio", "clean_ledger", "expand_hop", "explore_study", "flag", "gate_seeds",
    "hop", "hop_pairs", "khop", "label_set", "neighbour_account_trend", "neighbour_trend",
    "neighbourhood_study", "ratio_study", "read_accounts", "read_ledger", "recent_summary",
    "run_study", "seed_report", "time_window", "transactions", "trend", "trends",
    "write_clean_ledger",
]
