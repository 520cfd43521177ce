"""Exploration of the transfer graph around given accounts (C14-C18, U4).

These are the prototype analyses: star neighbourhoods (two-way, out-only,
sampled), ball growth to four steps, out-degrees and multi-edge
counterparties of direct neighbours, the vertex list, and labelled accounts
of one connected component. ``edges`` is the time-windowed ledger with
``from``/``to`` (zero-value rows kept, as the prototype reads the raw
export). Every operator takes a frame of centres keyed by ``seed_id`` and
runs all centres in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplens.operators.flows import account_flows
from hoplens.operators.labels import seed_frame
from hoplens.plans.strategy import (DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast, materialize,
                                    shuffle_join)

# Fixed parameters of the sampled star: fraction and seed of the sample.
SAMPLE_FRACTION = 0.0005
SAMPLE_SEED = 10
# Equal rows that are numbered at once.
OCCURRENCES = 4096


def _centres(seeds: DataFrame) -> DataFrame:
    return seed_frame(seeds)


def _touching(edges: DataFrame, ids: DataFrame, directions=("from", "to"),
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
              columns=("from", "to")) -> DataFrame:
    """Edge rows where an account of ``ids`` (seed_id, id[, direction]) is on
    one of ``directions``; one scan, both sides exploded (see account_flows)."""
    return account_flows(edges, ids, directions, max_broadcast_rows=max_broadcast_rows,
                         columns=columns)


def _other_end() -> Column:
    """The counterparty of the matched side."""
    return F.when(F.col("direction") == "from", F.col("to")).otherwise(F.col("from"))


def star_edges(edges: DataFrame, centres: DataFrame, mode: str = "both",
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Edge rows of each centre: 'out' (from = centre), 'in' (to = centre) or
    'both' (out rows ∪ in rows, bag). Output: seed_id, timestamp, from, to."""
    directions = {"out": ("from",), "in": ("to",), "both": ("from", "to")}.get(mode)
    if directions is None:
        raise ValueError(f"mode must be out, in or both, not {mode!r}")
    c = _centres(centres).select("seed_id", F.col("seed_id").alias("id"))
    rows = _touching(edges, c, directions, max_broadcast_rows, ("timestamp", "from", "to"))
    return rows.select("seed_id", "timestamp", "from", "to")


def hash_fraction(*cols: Column) -> Column:
    """A stable number in [0, 1) from the MD5 of the columns (engine-portable)."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2 ** 32))


def sample_rows(df: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED,
                method: str = "bernoulli") -> DataFrame:
    """T3 — Bernoulli sample without replacement.

    'bernoulli' is ``DataFrame.sample`` (depends on the partitioning);
    'hash' keeps a row when the MD5 of (seed, timestamp, from, to, occurrence)
    falls under the fraction: the same rows on every run, after any executor
    loss. Equal rows are counted first (a copy in a third of all rows travels
    once per task) and then drawn one by one, each by its number.
    """
    if method == "bernoulli":
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    if method == "hash":
        counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        # two steps, so that no array grows with the number of copies
        some = counted.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(OCCURRENCES))))
        last = F.least(F.col("_lo") + OCCURRENCES, F.col("_n")) - 1
        each = some.withColumn("_occurrence", F.explode(F.sequence(F.col("_lo"), last, F.lit(1))))
        h = hash_fraction(F.lit(str(seed)), F.col("timestamp"), F.col("from"), F.col("to"), F.col("_occurrence"))
        return each.where(h < F.lit(fraction)).select(*df.columns)
    raise ValueError(f"method must be bernoulli or hash, not {method!r}")


def with_labels(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """J6 — (keys..., id) left join the label set; label 0 when absent."""
    lab = labels.select("id", F.col("label").alias("_label")).distinct()
    return ids.join(lab, "id", "left").select(
        *ids.columns, F.coalesce(F.col("_label"), F.lit(0)).cast("int").alias("label"))


def star_export(edges: DataFrame, two_way: DataFrame, out_only: DataFrame,
                sampled: DataFrame, labels: DataFrame, fraction: float,
                seed: int = SAMPLE_SEED, method: str = "hash",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C14 — vertices (id, label) and edges (from, to) of three stars:
    a two-way star, an out-star and a sampled out-star. All centres are
    vertices. Returns (vertices, edges, sampled edges). ``fraction`` also thins
    the sampled star's part of the vertices and edges, so it has no default.

    One scan of the ledger serves the three stars: each centre is tagged with
    its role and the side(s) it matches on. The rows are stored once, after
    the sample is drawn, so the three outputs hold the same sample.
    """
    def role(df, name, directions):
        c = _centres(df)
        parts = [c.select("seed_id", F.col("seed_id").alias("id"), F.lit(d).alias("direction"),
                          F.lit(name).alias("role")) for d in directions]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    roles = (role(two_way, "two_way", ("from", "to"))
             .unionByName(role(out_only, "out", ("from",)))
             .unionByName(role(sampled, "sampled", ("from",))))
    rows = _touching(edges, roles, ("from", "to"), max_broadcast_rows,
                     ("timestamp", "from", "to"))
    plain = rows.where(F.col("role") != "sampled")
    smp = sample_rows(rows.where(F.col("role") == "sampled"), fraction, seed, method)
    all_edges = materialize(plain.unionByName(smp).select("role", "from", "to"), name="stars")
    centres = roles.select("id")
    vertex_ids = (all_edges.select(F.explode(F.array(F.col("from"), F.col("to"))).alias("id"))
                  .unionByName(centres).where(F.col("id").isNotNull()).distinct())
    vertices = with_labels(vertex_ids, labels)
    edge_pairs = all_edges.select("from", "to").distinct()
    return vertices, edge_pairs, all_edges.where(F.col("role") == "sampled").select("from", "to")


def out_neighbours(edges: DataFrame, ids: DataFrame,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct (seed_id, id) receivers of transfers sent by ``ids``."""
    rows = _touching(edges, ids.select("seed_id", "id"), ("from",), max_broadcast_rows)
    return rows.select("seed_id", F.col("to").alias("id")).where(F.col("id").isNotNull()).distinct()


def grow(edges: DataFrame, ball: DataFrame,
         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """One ball step: in(ball) ∪ out(ball) ∪ ball, distinct (seed_id, id)."""
    rows = _touching(edges, ball.select("seed_id", "id"), ("from", "to"), max_broadcast_rows)
    return (rows.select("seed_id", _other_end().alias("id"))
            .unionByName(ball.select("seed_id", "id"))
            .where(F.col("id").isNotNull()).distinct())


def ball_levels(edges: DataFrame, centres: DataFrame, checkpoint: bool = True,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                levels: int = 4) -> tuple[DataFrame, ...]:
    """C15/C16 — the first ``levels`` of (N1, B2, B3, B4) per centre.

    N1 = out-neighbours of the centre; B2 = out-neighbours of N1;
    B3 = in(B2) ∪ out(B2) ∪ B2; B4 = in(B3) ∪ out(B3) ∪ B3.
    """
    c = _centres(centres).select("seed_id", F.col("seed_id").alias("id"))
    found = [c]
    for step in (out_neighbours, out_neighbours, grow, grow)[:levels]:
        found.append(materialize(step(edges, found[-1], max_broadcast_rows), checkpoint))
    return tuple(found[1:])


def ball_edges(edges: DataFrame, ball: DataFrame,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct (seed_id, source, target) of transfers touching the ball."""
    rows = _touching(edges, ball.select("seed_id", "id"), ("from", "to"), max_broadcast_rows)
    return (rows.select("seed_id", F.col("from").alias("source"), F.col("to").alias("target"))
            .distinct())


def labelled_count(labelled_ball: DataFrame, centres: DataFrame) -> DataFrame:
    """F6 — per centre: number of ball members with label 1 (0 when none)."""
    n = labelled_ball.where(F.col("label") == 1).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))
    return _centres(centres).join(n, "seed_id", "left").select(
        "seed_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def out_degree(edges: DataFrame, ids: DataFrame,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """A5 — per (seed_id, account): number of transfers it sent (multi-edges
    counted). Output: seed_id, from, number."""
    rows = _touching(edges, ids.select("seed_id", "id"), ("from",), max_broadcast_rows)
    return rows.groupBy("seed_id", "from").agg(F.count(F.lit(1)).alias("number"))


def multi_edges(degrees: DataFrame, counts: tuple[int, ...] = (2, 3)) -> DataFrame:
    """C17 — accounts whose number of transfers is one of ``counts``."""
    return degrees.where(F.col("number").isin(list(counts)))


def all_vertices(edges: DataFrame) -> DataFrame:
    """U4 — distinct accounts that sent or received, as (id)."""
    e = edges.select("from", "to")
    ids = e.select(F.explode(F.array(F.col("from"), F.col("to"))).alias("id"))
    return ids.where(F.col("id").isNotNull()).distinct()


def component_labelled(components: DataFrame, labels: DataFrame, edges: DataFrame,
                       component: object | None = None,
                       max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C18 — labelled accounts of one component that also transact in ``edges``.

    ``components``: (id, component). Output: id, component, label. The labelled
    members of the component are the small side: the ledger's account columns
    are streamed once through a semi join against them (broadcast when their
    number is proven small), so the full vertex list is never built.
    """
    c = components.select(F.col("id").cast("string").alias("id"), "component")
    if component is not None:
        c = c.where(F.col("component") == F.lit(component))
    lab = labels.select("id", "label").distinct()
    members = materialize(c.join(lab, "id"), name="members")  # joined once, used three times
    cand = members.select("id").distinct()
    small, is_small = bounded_broadcast(cand, max_broadcast_rows)
    spread = tuple(c for c in ("timestamp", "from", "to") if c in edges.columns)
    ids = edges.select(F.explode(F.array(F.col("from"), F.col("to"))).alias("id"), *spread)
    if is_small:
        present = ids.join(small, "id", "left_semi")
    else:  # a hot account's rows are spread by the rows they come from
        present = shuffle_join(ids, cand, ["id"], "left_semi", spread=spread)
    present = present.select("id").distinct()
    return members.join(present, "id", "left_semi").select("id", "component", "label")
