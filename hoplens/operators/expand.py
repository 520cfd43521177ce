"""k-hop neighbourhood of seed accounts (C4-C7).

Semantics, for every seed at once (``seed_id`` is a key column):

* E is the set of (from, to) pairs of the ledger, read in both directions.
* Hop 1: every account that sent to or received from the seed; parent = seed.
  A self-transfer makes the seed its own hop-1 neighbour.
* Hop h+1: every neighbour b of a hop-h account p, minus the direct step back
  to p's own parent. There is no visited set: an account may appear at several
  hops, and the seed may come back through a triangle.
* One row per (seed, hop, id); the parent kept is the smallest.
* Optional cap per hop and seed: the ``cap`` smallest ids.
* Result: the union of the hops as (seed_id, id, originalAddress, label) where
  ``label`` is the hop number.

Plan per hop: one scan of the edge columns, exploded into both directions
(narrow, no shuffle of the ledger), a hash join against the frontier (a
broadcast when its size is proven small; otherwise a shuffle join that splits
a hot account, see ``strategy.shuffle_join``), a partial+final aggregate on
(seed, id) that collapses multi-edges map-side, then the per-seed cap as a
``row_number`` filter that Spark turns into a partial ``WindowGroupLimit`` in
front of the shuffle. Each hop is materialised in the checkpoint folder, so hop
h+1 reads hop h instead of recomputing the chain. ``adjacency.khop_shared`` gives
the same rows from a stored graph, without a scan of the ledger per hop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplens.operators.labels import gate_seeds, seed_frame
from hoplens.plans.strategy import (DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast, materialize,
                                    shuffle_join)

# Caps per hop (1..4) for callers who ask for a capped frontier; never a default.
DEFAULT_CAPS = (30, 25, 20, 10)

NEIGHBOUR_COLUMNS = ("seed_id", "id", "originalAddress", "label")


def adjacency(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(a, b): b is a neighbour of a. One scan; 'both' explodes each row twice."""
    e = edges.select(F.col("from").alias("src"), F.col("to").alias("dst"))
    if direction == "out":
        adj = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    elif direction == "in":
        adj = e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    elif direction == "both":
        adj = e.select(F.explode(F.array(
            F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
            F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")
        ).select("e.a", "e.b")
    else:
        raise ValueError(f"direction must be out, in or both, not {direction!r}")
    return adj.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def seed_frontier(seeds: DataFrame) -> DataFrame:
    """Hop-0 frontier: (seed_id, id=seed, parent=null)."""
    s = seed_frame(seeds)
    return s.select("seed_id", F.col("seed_id").alias("id"),
                    F.lit(None).cast("string").alias("parent"))


def _join_frontier(adj: DataFrame, frontier: DataFrame, max_broadcast_rows: int,
                   bound: int | None = None) -> DataFrame:
    """adj ⋈ frontier on ``a``: broadcast when proven small, else a shuffle join
    that splits a hot account (spread by its neighbours ``b``)."""
    small, is_small = bounded_broadcast(frontier, max_broadcast_rows, bound)
    if is_small:
        return adj.join(small, "a")
    return shuffle_join(adj, frontier, ["a"], spread=("b",))


def hop_pairs(edges: DataFrame, frontier: DataFrame, direction: str = "both",
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct (seed_id, p, b) for p in the frontier, minus p's step back.

    ``frontier`` has (seed_id, id, parent); the result has
    (seed_id, originalAddress=p, id=b). ``direction`` 'out' follows p->b
    transfers, 'in' b->p transfers, 'both' either.
    """
    f = frontier.select("seed_id", F.col("id").alias("a"), F.col("parent").alias("gp"))
    pairs = _join_frontier(adjacency(edges, direction), f, max_broadcast_rows)
    pairs = pairs.where(F.col("gp").isNull() | (F.col("b") != F.col("gp")))
    return pairs.select("seed_id", F.col("a").alias("originalAddress"),
                        F.col("b").alias("id")).distinct()


def expand_hop(edges: DataFrame, frontier: DataFrame, cap: int | None = None,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               frontier_bound: int | None = None) -> DataFrame:
    """One hop: (seed_id, id, parent) of the next frontier, deduped and capped.

    ``frontier_bound`` is a proven upper bound on the frontier's rows, if the
    caller has one (seeds x cap); otherwise the size is checked.
    """
    f = frontier.select("seed_id", F.col("id").alias("a"), F.col("parent").alias("gp"))
    pairs = _join_frontier(adjacency(edges, "both"), f, max_broadcast_rows, frontier_bound)
    pairs = pairs.where(F.col("gp").isNull() | (F.col("b") != F.col("gp")))
    level = pairs.groupBy("seed_id", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
    if cap is not None:
        level = cap_per_seed(level, cap)
    return level


def cap_per_seed(level: DataFrame, cap: int, order_by: str = "id") -> DataFrame:
    """Keep the ``cap`` rows with the smallest ``order_by`` per seed."""
    w = Window.partitionBy("seed_id").orderBy(F.col(order_by))
    return (level.withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") <= cap).drop("_rn"))


def _caps_for(hops: int, caps: Sequence[int | None] | None) -> list[int | None]:
    if caps is None:
        return [None] * hops
    caps = list(caps)
    if len(caps) < hops:
        caps += [None] * (hops - len(caps))
    return caps[:hops]


def khop(edges: DataFrame, seeds: DataFrame, *, labels: DataFrame | None = None,
         hops: int = 4, caps: Sequence[int | None] | None = None,
         require_labelled: bool = True, checkpoint: bool = True,
         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C6/C7 — neighbourhood up to ``hops`` of every seed.

    ``edges``: ledger rows with ``from``/``to`` (window and zero filter applied
    by the caller). ``seeds``: DataFrame[id] or [seed_id]. ``labels``: the label
    set; with ``require_labelled`` only seeds in it are expanded (C3).
    ``caps``: per-hop cap per seed (keeps the smallest ids); by default none.
    """
    if hops < 1:
        raise ValueError("hops must be >= 1")
    # the raw seed rows bound the gated seeds and every capped frontier
    # (seeds x cap): the small gate plan feeds hop 1's broadcast directly
    n_input = seeds.count()
    gated = gate_seeds(seeds, labels, require_labelled, max_broadcast_rows, n_input)
    frontier = seed_frontier(gated)
    bound = n_input
    levels = []
    for h, cap in enumerate(_caps_for(hops, caps), start=1):
        next_bound = n_input * cap if cap is not None else None
        frontier = materialize(expand_hop(edges, frontier, cap, max_broadcast_rows, bound),
                               checkpoint, name=f"hop{h}")
        bound = next_bound
        levels.append(frontier.select("seed_id", "id", F.col("parent").alias("originalAddress"),
                                      F.lit(h).alias("label")))
    # (seed, id, hop) is unique by construction: the union needs no distinct
    return reduce(DataFrame.unionByName, levels)


def hop(neighbours: DataFrame, h: int) -> DataFrame:
    """Rows of one hop of a ``khop`` result."""
    return neighbours.where(F.col("label") == h)
