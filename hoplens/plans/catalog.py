"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the shared test tables through ``hoplens.sources.fixtures``
and runs the library operators over all of them; the seeds are the fixture's
seed list (five blacklisted accounts plus one unlabelled account that the
seed gate must reject). Buckets are rendered in UTC and sums are exact
(decimal with two places) so that results compare bit-for-bit with the SQL
oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplens.operators import adjacency, clean, cube, expand, explore, flows, labels, report
from hoplens.functions.time import bucket
from hoplens.plans.sinks import with_percent, write_table
from hoplens.plans.strategy import materialize
from hoplens.sources import fixtures as fx
from hoplens.sources.ledger import read_accounts, read_ledger

TZ = "UTC"
AMOUNT_SCALE = 2

Query = Callable[[SparkSession, str], DataFrame]


# ---- shared inputs ---------------------------------------------------------

def _ledger(spark, d):
    return fx.ledger(spark, d)


def _cube(spark, d):
    return fx.flow_cube(spark, d, AMOUNT_SCALE)


def _graph(spark, d):
    return fx.graph_edges(spark, d)


def _labels(spark, d):
    return labels.label_set(fx.labelled(spark, d), fx.blacklist(spark, d))


def _seeds(spark, d):
    return fx.seeds(spark, d)


def _khop(spark, d, hops=4, caps=None):
    return adjacency.khop_shared(fx.transfer_graph(spark, d), _gated(spark, d), hops, caps)


def _gated(spark, d):
    return labels.gate_seeds(_seeds(spark, d), _labels(spark, d))


def _hop1(spark, d):
    """The hop-1 frontier (seed_id, id, parent), straight from the ledger."""
    k = expand.khop(_ledger(spark, d), _seeds(spark, d), labels=_labels(spark, d), hops=1)
    return k.select("seed_id", "id", F.col("originalAddress").alias("parent"))


def _flagged(spark, d):
    """The flagged neighbourhood, stored once per application for what is built on it."""
    return fx._stored_table(spark, d, "flagged", lambda path: labels.flag(
        materialize(_khop(spark, d), name="khop"), fx.blacklist(spark, d)).write.parquet(path))


def _balls(spark, d, levels):
    return adjacency.grow_balls(fx.transfer_graph(spark, d, "graph"), _gated(spark, d), levels)


# ---- queries -----------------------------------------------------------------

def q_ledger_clean(spark, d):
    # the cleaning step itself, straight from the source tables
    return clean.clean_ledger(fx.ledger_raw(spark, d), fx.YEAR_START, fx.YEAR_END)


def q_label_set(spark, d):
    return _labels(spark, d)


def q_seed_lookup(spark, d):
    return labels.gate_seeds(_seeds(spark, d), _labels(spark, d))


def q_hop1(spark, d):
    return _khop(spark, d, hops=1, caps=None)


def _hop2_pairs(spark, d, direction):
    pairs = expand.hop_pairs(_ledger(spark, d), _hop1(spark, d), direction)
    return pairs.select("seed_id", "originalAddress", "id", F.lit(2).alias("label"))


def q_hop2_out(spark, d):
    return _hop2_pairs(spark, d, "out")


def q_hop2_in(spark, d):
    return _hop2_pairs(spark, d, "in")


def q_hop2_frontier(spark, d):
    # from the ledger itself; the other hop queries read the stored graph
    level = expand.expand_hop(_ledger(spark, d), _hop1(spark, d), cap=None)
    return level.select("seed_id", "id", F.col("parent").alias("originalAddress"), F.lit(2).alias("label"))


def q_khop_capped(spark, d):
    # the hop cap itself (T2); nothing else is built on a capped neighbourhood
    return _khop(spark, d, caps=expand.DEFAULT_CAPS)


def q_khop2_uncapped(spark, d):
    return expand.hop(_khop(spark, d, hops=2, caps=None), 2)


def q_khop4_uncapped(spark, d):
    return _khop(spark, d, hops=4, caps=None)


def q_neighbours_flagged(spark, d):
    return _flagged(spark, d)


def q_black_neighbours(spark, d):
    return labels.black_neighbours(_flagged(spark, d))


def q_blacklist_ratio(spark, d):
    hop2 = expand.hop(_khop(spark, d, hops=2, caps=None), 2)
    flagged = materialize(labels.flag(materialize(hop2, name="hop2"), fx.blacklist(spark, d)), name="flagged")
    return labels.blacklist_ratio(flagged, _seeds(spark, d))


def q_blacklist_percent(spark, d):
    return with_percent(q_blacklist_ratio(spark, d)).select("seed_id", "percent")


def q_account_transactions(spark, d):
    tx = flows.transactions(_ledger(spark, d), flows.seed_accounts(_seeds(spark, d)), tz=TZ)
    return tx.select("seed_id", "timestamp", "time", "from", "to", "value")


def q_neighbour_transactions(spark, d):
    # stored once per account, joined with the seeds' accounts
    path = fx._stored_path(spark, d, "touching", lambda path: flows.store_touching(
        _ledger(spark, d), materialize(flows.tracked_accounts(_flagged(spark, d), ("seed_id",)), name="tracked"), path))
    return flows.touching_transactions(spark, path, tz=TZ)


def q_account_transactions_typed(spark, d):
    tx = flows.transactions(_ledger(spark, d), flows.seed_accounts(_seeds(spark, d)), tz=TZ, typed=True)
    return tx.select("seed_id", "timestamp", "from", "to", "value", "at")


def q_account_time_of_day(spark, d):
    tx = flows.account_flows(_ledger(spark, d), flows.seed_accounts(_seeds(spark, d)))
    return (tx.groupBy("seed_id", bucket("timestamp", "time_of_day", TZ).alias("time_of_day"))
            .agg(F.count(F.lit(1)).alias("count")))


def q_account_daily_exact(spark, d):
    out = flows.account_trend(_ledger(spark, d), _seeds(spark, d), "day", TZ, "exact")
    return out.withColumn("total_amount", F.round("total_amount", 2))


def q_ledger_csv(spark, d):
    # the cleaned ledger written as CSV with a header and read back by its names
    path = fx._stored_path(spark, d, "ledger-csv", lambda path: clean.write_clean_ledger(
        q_ledger_clean(spark, d), path, mode="overwrite", fmt="csv"))
    return read_ledger(spark, path, "csv").select("timestamp", "from", "to", "value")


def q_accounts_csv(spark, d):
    path = fx._stored_path(spark, d, "accounts-csv", lambda path: write_table(
        fx.blacklist(spark, d), path, "csv", "overwrite"))
    return read_accounts(spark, path, "blacklist").distinct()


def q_ledger_month(spark, d):
    # one month of the year's ledger, which is laid out by days
    path = fx._stored_path(spark, d, "ledger-days", lambda path: clean.write_daily_ledger(
        _graph(spark, d), path, mode="overwrite"))
    return clean.read_daily_ledger(spark, path, fx.RECENT_START, fx.RECENT_END)


def q_hub_sample(spark, d):
    # the sample over the whole graph, equal rows drawn one by one
    rows = explore.sample_rows(_graph(spark, d), STAR_FRACTION, method="hash")
    return rows.groupBy("from").agg(F.count(F.lit(1)).alias("rows"))


def _neighbour_trend(unit):
    def q(spark, d):
        accounts = flows.tracked_accounts(_flagged(spark, d), ("seed_id", labels.FLAG))
        return cube.cube_trend(_cube(spark, d), accounts, unit, ("seed_id", labels.FLAG), TZ)
    q.__name__ = f"q_trend_{unit}"
    return q


def q_account_daily(spark, d):
    # straight from the ledger; the other trends read the cube
    return flows.account_trend(_ledger(spark, d), _seeds(spark, d), "day", TZ, AMOUNT_SCALE)


def q_neighbour_account_daily(spark, d):
    accounts = flows.tracked_accounts(_flagged(spark, d), ("seed_id",))
    return cube.cube_trend(_cube(spark, d), accounts, "day", ("seed_id", "id"), TZ)


def q_account_hour_of_day(spark, d):
    return cube.cube_trend(_cube(spark, d), flows.seed_accounts(_seeds(spark, d)), "hour_of_day", ("seed_id",), TZ)


def _recent(spark, d, flagged):
    return cube.cube_recent(_cube(spark, d), flagged, fx.RECENT_START, fx.RECENT_END, _seeds(spark, d))


def q_recent_summary(spark, d):
    return _recent(spark, d, _flagged(spark, d))


def q_seed_report(spark, d):
    flagged = _flagged(spark, d)
    return report.seed_report(flagged, _recent(spark, d, flagged), _seeds(spark, d))


# a share that leaves rows on every test table
STAR_FRACTION = 0.5


def _stars(spark, d):
    s = _seeds(spark, d).join(_gated(spark, d).withColumnRenamed("seed_id", "id"), "id", "left_semi")
    return explore.star_export(
        _graph(spark, d), s.where(F.col("seed_no") == 1), s.where(F.col("seed_no") == 2),
        s.where(F.col("seed_no") == 3), _labels(spark, d), fraction=STAR_FRACTION, method="hash")


def q_star_vertices(spark, d):
    return _stars(spark, d)[0]


def q_star_edges(spark, d):
    return _stars(spark, d)[1]


def q_star_sampled(spark, d):
    return _stars(spark, d)[2]


def q_hop_out_degree(spark, d):
    return adjacency.out_degrees(_balls(spark, d, 1))


def q_multi_edge(spark, d):
    return explore.multi_edges(adjacency.out_degrees(_balls(spark, d, 1)))


def _ball(spark, d, level):
    """Level 2, 3 or 4 of the balls."""
    return _balls(spark, d, level).level(level)


def q_ball2(spark, d):
    return _ball(spark, d, 2)


def q_ball3(spark, d):
    return explore.with_labels(_ball(spark, d, 3), _labels(spark, d))


def q_ball4(spark, d):
    return explore.with_labels(_ball(spark, d, 4), _labels(spark, d))


def q_ball4_edges(spark, d):
    return _balls(spark, d, 4).edges()


def q_ball_black_count(spark, d):
    ball4 = explore.with_labels(_ball(spark, d, 4), _labels(spark, d))
    return explore.labelled_count(ball4, _seeds(spark, d))


def q_all_vertices(spark, d):
    return fx.transfer_graph(spark, d, "graph").accounts.select("id")


def q_component_labelled(spark, d):
    return explore.component_labelled(fx.components(spark, d), _labels(spark, d),
                                      _graph(spark, d), fx.COMPONENT)


QUERIES: dict[str, Query] = {
    "ledger_clean": q_ledger_clean,
    "label_set": q_label_set,
    "seed_lookup": q_seed_lookup,
    "hop1": q_hop1,
    "hop2_out": q_hop2_out,
    "hop2_in": q_hop2_in,
    "hop2_frontier": q_hop2_frontier,
    "khop_capped": q_khop_capped,
    "khop2_uncapped": q_khop2_uncapped,
    "khop4_uncapped": q_khop4_uncapped,
    "neighbours_flagged": q_neighbours_flagged,
    "black_neighbours": q_black_neighbours,
    "blacklist_ratio": q_blacklist_ratio,
    "blacklist_percent": q_blacklist_percent,
    "account_transactions": q_account_transactions,
    "account_transactions_typed": q_account_transactions_typed,
    "account_time_of_day": q_account_time_of_day,
    "account_daily_exact": q_account_daily_exact,
    "ledger_csv": q_ledger_csv,
    "accounts_csv": q_accounts_csv,
    "ledger_month": q_ledger_month,
    "hub_sample": q_hub_sample,
    "neighbour_transactions": q_neighbour_transactions,
    "trend_daily": _neighbour_trend("day"),
    "trend_hourly": _neighbour_trend("hour"),
    "trend_monthly": _neighbour_trend("month"),
    "account_daily": q_account_daily,
    "account_hour_of_day": q_account_hour_of_day,
    "neighbour_account_daily": q_neighbour_account_daily,
    "recent_summary": q_recent_summary,
    "seed_report": q_seed_report,
    "star_vertices": q_star_vertices,
    "star_edges": q_star_edges,
    "star_sampled": q_star_sampled,
    "hop_out_degree": q_hop_out_degree,
    "multi_edge": q_multi_edge,
    "ball2": q_ball2,
    "ball3": q_ball3,
    "ball4": q_ball4,
    "ball4_edges": q_ball4_edges,
    "ball_black_count": q_ball_black_count,
    "all_vertices": q_all_vertices,
    "component_labelled": q_component_labelled,
}
