"""The full neighbourhood study for a list of seeds, as one Spark application.

For all seeds at once (``seed_id`` is a key column, not a loop):

1. transactions of every seed account;
2. k-hop neighbourhood of every labelled seed (materialised per hop);
3. blacklist flag of every neighbour;
4. transactions of every neighbour, written as ``seed_id=/id=`` folders;
5. recent-window totals of the blacklisted neighbours;
6. daily and hourly flow trends of blacklisted / other neighbours, both
   directions;
7. one report row per seed.

The flagged neighbourhood is materialised once and reused by steps 4-7; hops
are found in the stored graph of the ledger, and the recent totals and the
trends of every granularity in its stored hourly flows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from hoplens.operators.adjacency import build_graph, khop_shared
from hoplens.operators.cube import build_cube, cube_recent, cube_trend
from hoplens.operators.expand import khop
from hoplens.operators.flows import recent_summary, seed_accounts, tracked_accounts, transactions
from hoplens.operators.labels import FLAG, blacklist_ratio, flag, gate_seeds, label_set, seed_frame
from hoplens.operators.report import seed_report
from hoplens.plans.sinks import pending_keys, with_percent, write_table
from hoplens.plans.stages import StageStore, describe
from hoplens.plans.strategy import DEFAULT_MAX_BROADCAST_ROWS, materialize, rows_bound, stage_path


@dataclass
class StudyConfig:
    hops: int = 4
    caps: Sequence[int | None] | None = None
    require_labelled: bool = True
    recent_start: int | None = None
    recent_end: int | None = None
    tz: str | None = None
    amount_scale: int | None = None
    units: Sequence[str] = ("day", "hour")
    fmt: str = "parquet"
    mode: str = "errorifexists"
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS


def neighbourhood_study(ledger: DataFrame, seeds: DataFrame, labelled: DataFrame | None,
                        blacklist: DataFrame, cfg: StudyConfig | None = None
                        ) -> dict[str, DataFrame]:
    """Build every output of the study as DataFrames (materialised stages included)."""
    cfg = cfg or StudyConfig()
    labels = label_set(labelled, blacklist)
    gated = gate_seeds(seeds, labels, cfg.require_labelled, cfg.max_broadcast_rows)
    graph = build_graph(ledger.select("from", "to"), stage_path(ledger.sparkSession, "graph"))
    neighbours = materialize(khop_shared(graph, gated, cfg.hops, cfg.caps), name="neighbours")
    flagged = materialize(flag(neighbours, blacklist, cfg.max_broadcast_rows), name="flagged")
    # one hourly aggregate of the ledger serves the recent totals and every trend
    cube = build_cube(ledger, stage_path(ledger.sparkSession, "cube"), cfg.amount_scale)
    if any(b is not None and b % cube.step for b in (cfg.recent_start, cfg.recent_end)):
        summary = recent_summary(ledger, flagged, cfg.recent_start, cfg.recent_end, seeds,
                                 cfg.amount_scale, cfg.max_broadcast_rows)
    else:
        summary = cube_recent(cube, flagged, cfg.recent_start, cfg.recent_end, seeds)
    summary = materialize(summary, name="summary")
    out = {
        "seed_transactions": transactions(ledger, seed_accounts(seeds), cfg.tz,
                                          max_broadcast_rows=cfg.max_broadcast_rows),
        "neighbours": neighbours,
        "neighbours_flagged": flagged,
        "neighbour_transactions": transactions(
            ledger, tracked_accounts(flagged, ("seed_id",)), cfg.tz,
            max_broadcast_rows=cfg.max_broadcast_rows,
            accounts_bound=rows_bound(flagged)),
        "recent_summary": summary,
        "blacklist_ratio": blacklist_ratio(flagged, seeds),
    }
    accounts = tracked_accounts(flagged, ("seed_id", FLAG))
    for unit in cfg.units:
        out[f"trend_{unit}"] = cube_trend(cube, accounts, unit, ("seed_id", FLAG), cfg.tz)
    # written last: its rows tell which seeds are complete
    out["seed_report"] = seed_report(flagged, summary, seeds, cfg.hops)
    return out


# per-seed folders, as the per-account layout of the study
LAYOUT = {
    "seed_transactions": ("seed_id",),
    "neighbours": ("seed_id",),
    "neighbours_flagged": ("seed_id",),
    "neighbour_transactions": ("seed_id", "id"),
}


def run_study(ledger: DataFrame, seeds: DataFrame, labelled: DataFrame | None,
              blacklist: DataFrame, out_dir: str, cfg: StudyConfig | None = None
              ) -> dict[str, str]:
    """Write every output under ``out_dir``; returns name -> path.

    In mode 'missing' seeds with a commit record of ``seed_report`` (written
    last) are complete and not computed again; the others are added to every
    output in an attempt of their own, and are recorded output by output.
    The stages live as long as the job: they are removed when it ends, and read
    again when a job that failed is run again on the same inputs and settings.
    """
    cfg = cfg or StudyConfig()
    spark = ledger.sparkSession
    if cfg.mode == "missing":
        seeds = pending_keys(seed_frame(seeds), f"{out_dir.rstrip('/')}/seed_report", ("seed_id",))
        if seeds.isEmpty():
            return {name: f"{out_dir.rstrip('/')}/{name}" for name in outputs_of(cfg)}
    inputs = [describe(df) for df in (ledger, seeds, labelled, blacklist) if df is not None]
    with StageStore(spark, ["study", asdict(cfg), out_dir, inputs]):
        seeds = materialize(seed_frame(seeds), name="pending")
        outputs = neighbourhood_study(ledger, seeds, labelled, blacklist, cfg)
        return write_all(outputs, out_dir, cfg.fmt, cfg.mode, seeds)


def outputs_of(cfg: StudyConfig) -> list[str]:
    """The names of a study's outputs, in the order in which they are written."""
    return ["seed_transactions", "neighbours", "neighbours_flagged", "neighbour_transactions", "recent_summary",
            "blacklist_ratio", *[f"trend_{u}" for u in cfg.units], "seed_report"]


def ratio_study(ledger: DataFrame, seeds: DataFrame, labelled: DataFrame | None,
                blacklist: DataFrame, require_labelled: bool = True,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> dict[str, DataFrame]:
    """The neighbour-ratio job: uncapped two-hop expansion, hop-2 neighbours
    flagged, the blacklisted share per seed, and that share as text."""
    labels = label_set(labelled, blacklist)
    hop2 = khop(ledger, seeds, labels=labels, hops=2, caps=None,
                require_labelled=require_labelled, max_broadcast_rows=max_broadcast_rows)
    hop2 = hop2.where(hop2.label == 2)
    flagged = materialize(flag(hop2, blacklist, max_broadcast_rows), name="flagged")
    ratio = blacklist_ratio(flagged, seeds)
    return {"hop2_flagged": flagged, "blacklist_ratio": ratio,
            "blacklist_percent": with_percent(ratio).select("seed_id", "percent")}


def explore_study(graph: DataFrame, two_way: DataFrame, out_only: DataFrame,
                  sampled: DataFrame, ball_centres: DataFrame, labelled: DataFrame | None,
                  blacklist: DataFrame, fraction: float,
                  method: str = "hash", require_labelled: bool = True) -> dict[str, DataFrame]:
    """The graph prototype: three stars with vertex labels, then out-degrees
    of the ball centres' direct neighbours and the ball growth to four steps.
    ``graph`` is the windowed ledger with zero-value rows kept. Only centres in
    the label set are explored (``require_labelled``). Of the ``sampled`` centres'
    edges a part of ``fraction`` enters the star outputs."""
    from hoplens.operators import explore

    labels = label_set(labelled, blacklist)
    two_way, out_only, sampled, gated = (gate_seeds(c, labels, require_labelled)
                                         for c in (two_way, out_only, sampled, ball_centres))
    vertices, edges, sampled_edges = explore.star_export(graph, two_way, out_only, sampled,
                                                         labels, fraction, method=method)
    n1, _, b3, b4 = explore.ball_levels(graph, gated)
    degrees = explore.out_degree(graph, n1)
    b4_labelled = explore.with_labels(b4, labels)
    return {
        "star_vertices": vertices,
        "star_edges": edges,
        "star_sampled": sampled_edges,
        "out_degree": degrees,
        "multi_edges": explore.multi_edges(degrees),
        "ball3": explore.with_labels(b3, labels),
        "ball4": b4_labelled,
        "ball4_edges": explore.ball_edges(graph, b3),
        "ball_black_count": explore.labelled_count(b4_labelled, ball_centres),
    }


# outputs with at most one row per seed: one file each, as the original's
# single-file reports (never used for transaction-sized outputs)
SINGLE_FILE = {"seed_report", "recent_summary", "blacklist_ratio", "blacklist_percent",
               "ball_black_count"}


def write_all(outputs: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
              mode: str = "errorifexists", seeds: DataFrame | None = None) -> dict[str, str]:
    """Write all outputs. In mode 'missing' they share an attempt, and ``seeds``
    (pending ones) are complete in an output when it is written, with or without rows."""
    paths = {}
    attempt = uuid.uuid4().hex
    for name, df in outputs.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        keys = LAYOUT.get(name) or (("seed_id",) if "seed_id" in df.columns else None)
        by_seed = mode == "missing" and seeds is not None and "seed_id" in df.columns
        write_table(df, path, fmt, mode, LAYOUT.get(name), single_file=name in SINGLE_FILE,
                    keys=("seed_id",) if by_seed else keys,
                    done=pending_keys(seeds, path, ("seed_id",)) if by_seed else None, attempt=attempt)
        paths[name] = path
    return paths
