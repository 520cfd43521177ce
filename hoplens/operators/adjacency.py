"""The transfer graph as a stored table, and expansions over it (C4-C7, C15-C17).

``build_graph`` reduces a ledger to

* ``accounts``: (id, key), a long for every account; the keys follow the order
  of the ids, so the smallest key is the smallest account;
* ``pairs``: (part, a, b, sent, received), one row per ordered pair of accounts
  that had a transfer, with the number of transfers in each direction; ``part``
  is a hash of ``a`` and the table's folder layout.

All expansions read ``pairs`` alone, never the ledger again: where a frontier
is stored small enough to be broadcast (Catalyst decides by its file sizes), its
``part`` values prune the folders that are read at run time, and no pair is
shuffled. Above that size the join shuffles pairs, not transfers.

A frontier holds (id, parent, seeds): accounts that several seeds reached by the
same parent are one row with the set of those seeds, so a hub that many seeds
share is expanded once, and the pairs it yields do not multiply with the seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplens.operators.labels import seed_frame
from hoplens.plans.strategy import materialize, shuffle_join

#: Pairs in a part when the number of parts is not given, and parts at most.
PAIRS_PER_PART, MAX_PARTS = 4_000_000, 4096


@dataclass
class Graph:
    accounts: DataFrame
    pairs: DataFrame
    parts: int


def account_keys(edges: DataFrame) -> DataFrame:
    """(id, key) of all accounts that sent or received; keys are in order of
    the ids. A range sort, so no task holds more than its range; it reads the
    distinct ids twice (for its bounds and its rows), so they are stored."""
    ids = edges.select(F.explode(F.array("from", "to")).alias("id")).where("id is not null").distinct()
    ids = materialize(ids, name="ids")
    return ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("key"))


def part_of(key, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def graph_pairs(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """(a, b, sent, received) by keys, both ways; transfers are counted per pair
    before anything is joined, and a hot account's pairs are spread."""
    transfers = (edges.where(F.col("from").isNotNull() & F.col("to").isNotNull())
                 .groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")))
    for end, key in (("from", "src"), ("to", "dst")):
        other = "to" if end == "from" else "src"
        names = accounts.select(F.col("id").alias(end), F.col("key").alias(key))
        transfers = shuffle_join(transfers, names, [end], spread=(other,), sieve=False).drop(end)
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("sent"),
                            F.lit(0).cast("long").alias("received")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0).cast("long").alias("sent"),
                            F.col("n").alias("received")))
    return (transfers.select(F.inline(ways)).groupBy("a", "b")
            .agg(F.sum("sent").alias("sent"), F.sum("received").alias("received")))


def build_graph(edges: DataFrame, path: str, parts: int | None = None) -> Graph:
    """Store the graph of ``edges`` (from, to) under ``path``. A part that is
    too large, as that of a hot account, is written in several files; readers
    prune by the part alone, so no order by account is made inside it."""
    spark = edges.sparkSession
    base = path.rstrip("/")
    account_keys(edges).write.mode("overwrite").parquet(f"{base}/accounts")
    accounts = spark.read.schema("id string, key long").parquet(f"{base}/accounts")
    pairs = graph_pairs(edges, accounts)
    if parts is None:
        pairs = materialize(pairs, name="pairs")
        parts = max(1, min(MAX_PARTS, -(-pairs.count() // PAIRS_PER_PART)))
    (pairs.withColumn("part", part_of("a", parts)).hint("rebalance", "part")
     .write.mode("overwrite").partitionBy("part").parquet(f"{base}/pairs"))
    spark.range(0, 1, 1, 1).select(F.lit(parts).cast("int").alias("parts")).write.mode("overwrite").json(f"{base}/parts")
    return open_graph(spark, path)


def open_graph(spark, path: str) -> Graph:
    """A graph that ``build_graph`` stored."""
    base = path.rstrip("/")
    parts = spark.read.schema("parts int").json(f"{base}/parts").first()["parts"]
    return Graph(spark.read.schema("id string, key long").parquet(f"{base}/accounts"),
                 spark.read.schema("a long, b long, sent long, received long, part int").parquet(f"{base}/pairs"), parts)


def seed_keys(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(key, seed_id) of the seeds that are in the graph."""
    return graph.accounts.join(seed_frame(seeds).withColumnRenamed("seed_id", "id"), "id").select(
        "key", F.col("id").alias("seed_id"))


def pairs_of(graph: Graph, frontier: DataFrame) -> DataFrame:
    """The pairs whose ``a`` is an id of ``frontier``, with its other columns.
    The comparison lets Catalyst prune the parts by the frontier's."""
    f = (frontier.withColumnRenamed("id", "a").withColumn("part", part_of("a", graph.parts))
         .where(F.col("part") >= 0))
    return graph.pairs.join(f, ["part", "a"]).drop("part")


def expand_shared(graph: Graph, frontier: DataFrame) -> DataFrame:
    """The next frontier: for every seed the neighbours of its accounts, less the
    step back to the parent, each with its smallest parent."""
    steps = pairs_of(graph, frontier).where("parent is null or b <> parent")
    # one row per neighbour and set of seeds; a hash aggregate over longs
    ways = steps.groupBy(F.col("b").alias("id"), "seeds").agg(F.min("a").alias("parent"))
    # where sets overlap, a seed goes with the smallest parent (as many ways as there are sets of seeds)
    ways = ways.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("parent", "seeds"))).alias("ways"))
    split = F.expr("""aggregate(ways,
        named_struct('seen', cast(array() as array<bigint>), 'out', cast(array() as array<struct<parent:bigint,seeds:array<bigint>>>)),
        (s, w) -> named_struct('seen', array_union(s.seen, w.seeds),
            'out', concat(s.out, array(named_struct('parent', w.parent, 'seeds', array_except(w.seeds, s.seen))))),
        s -> filter(s.out, o -> size(o.seeds) > 0))""")
    one = F.size("ways") == 1
    return ways.select("id", F.inline(F.when(one, F.col("ways")).otherwise(split))).select(
        "id", "parent", F.array_sort("seeds").alias("seeds"))


def capped(frontier: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` smallest ids of each seed."""
    each = frontier.select("id", "parent", F.explode("seeds").alias("seed"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("id"))
    return (each.withColumn("_rank", rank).where(F.col("_rank") <= cap).groupBy("id", "parent")
            .agg(F.array_sort(F.collect_list("seed")).alias("seeds")))


def named(graph: Graph, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace columns of keys by the accounts' ids. ``rows`` is stored; the
    accounts are streamed once past the keys that occur."""
    used = reduce(DataFrame.unionByName, [rows.select(F.col(k).alias("key")) for k in keys])
    names = materialize(graph.accounts.join(used.where("key is not null").distinct(), "key"), name="names")
    for k in keys:
        rows = (rows.withColumnRenamed(k, "key").join(names.withColumnRenamed("id", "_id"), "key", "left")
                .drop("key").withColumnRenamed("_id", k))
    return rows


def khop_shared(graph: Graph, seeds: DataFrame, hops: int = 4,
                caps: Sequence[int | None] | None = None) -> DataFrame:
    """C6/C7 over a stored graph: the rows of ``expand.khop`` (seed_id, id,
    originalAddress, label) for ``seeds`` (already gated)."""
    start = materialize(seed_keys(graph, seeds), name="seeds")
    frontier = start.select(F.col("key").alias("id"), F.lit(None).cast("long").alias("parent"),
                            F.array("key").alias("seeds"))
    caps = list(caps or [])[:hops]
    levels = []
    for h, cap in enumerate(caps + [None] * (hops - len(caps)), start=1):
        step = expand_shared(graph, frontier)
        frontier = materialize(step if cap is None else capped(step, cap), name=f"shared{h}")
        levels.append(frontier.withColumn("label", F.lit(h)))
    found = named(graph, reduce(DataFrame.unionByName, levels), ("id", "parent"))
    out = found.withColumn("key", F.explode("seeds")).join(start, "key")
    return out.select("seed_id", "id", F.col("parent").alias("originalAddress"), "label")


# --- balls -------------------------------------------------------------------

def _merged(rows: DataFrame) -> DataFrame:
    """(id, seeds): the seeds of an id from several rows as one set."""
    return (rows.select("id", F.explode("seeds").alias("seed")).distinct().groupBy("id")
            .agg(F.array_sort(F.collect_list("seed")).alias("seeds")))


@dataclass
class Balls:
    """Stored levels of ball growth by keys: ``members`` (level -> id, seeds)
    and the steps made for each expanded member (a, b, sent, received, seeds)."""
    graph: Graph
    start: DataFrame
    members: dict[int, DataFrame]
    steps: list[DataFrame]

    def _out(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return named(self.graph, rows, keys).join(
            self.start.select(F.col("key").alias("seed"), "seed_id"), "seed").drop("seed")

    def level(self, n: int) -> DataFrame:
        """(seed_id, id) of level 1 (receivers), 2 (theirs), 3 or 4."""
        rows = self.members[n].select(F.explode("seeds").alias("seed"), "id")
        return self._out(rows, ("id",)).select("seed_id", "id")

    def edges(self) -> DataFrame:
        """Distinct (seed_id, source, target) of transfers that touch level 3:
        the steps of its members, which were made to find level 4."""
        ways = F.array(F.when(F.col("sent") > 0, F.struct(F.col("a").alias("source"), F.col("b").alias("target"))),
                       F.when(F.col("received") > 0, F.struct(F.col("b").alias("source"), F.col("a").alias("target"))))
        rows = reduce(DataFrame.unionByName, self.steps)
        rows = (rows.select("seeds", F.explode(ways).alias("e")).where("e is not null")
                .groupBy("e.source", "e.target").agg(F.array_distinct(F.flatten(F.collect_set("seeds"))).alias("seeds")))
        rows = materialize(rows, name="edges").select(F.explode("seeds").alias("seed"), "source", "target")
        return self._out(rows, ("source", "target")).select("seed_id", "source", "target")


def grow_balls(graph: Graph, seeds: DataFrame, levels: int = 4) -> Balls:
    """C15/C16 — N1 = receivers of the centre, B2 = receivers of N1,
    B3 = B2 ∪ N(B2), B4 = B3 ∪ N(B3 \\ B2), each vertex expanded once."""
    start = materialize(seed_keys(graph, seeds), name="centres")
    at = start.select(F.col("key").alias("id"), F.array("key").alias("seeds"))
    members: dict[int, DataFrame] = {}
    for n in (1, 2)[:levels]:
        step = pairs_of(graph, at).where("sent > 0").select(F.col("b").alias("id"), "seeds").distinct()
        at = members[n] = materialize(_merged(step), name=f"ball{n}")
    steps = []
    fresh = members.get(2)
    for n in range(3, levels + 1):
        steps.append(materialize(pairs_of(graph, fresh), name=f"steps{n}"))
        met = steps[-1].select(F.col("b").alias("id"), "seeds").distinct()
        members[n] = materialize(_merged(members[n - 1].unionByName(met)), name=f"ball{n}")
        before = members[n - 1].select("id", F.col("seeds").alias("_old"))
        left = F.array_except("seeds", F.coalesce("_old", F.array().cast("array<bigint>")))
        fresh = (members[n].join(before, "id", "left").select("id", left.alias("seeds")).where("size(seeds) > 0"))
    return Balls(graph, start, members, steps)


def out_degrees(balls: Balls) -> DataFrame:
    """A5 — per receiver of a centre the transfers it sent: seed_id, from, number."""
    counts = (pairs_of(balls.graph, balls.members[1]).where("sent > 0")
              .groupBy("a", "seeds").agg(F.sum("sent").alias("number")))
    rows = materialize(counts, name="degrees").select(F.explode("seeds").alias("seed"), F.col("a").alias("from"), "number")
    return balls._out(rows, ("from",)).select("seed_id", "from", "number")
