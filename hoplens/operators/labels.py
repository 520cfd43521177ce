"""Label set, seed gate, blacklist flag and blacklisted share (C2, C3, C8, C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.functions.amounts import safe_ratio
from hoplens.plans.strategy import DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast, rows_bound
from hoplens.sources.ledger import account_ids

FLAG = "isInBlackListResult"


def label_set(labelled: DataFrame | None, blacklist: DataFrame | None) -> DataFrame:
    """C2 — labelled accounts ∪ blacklist, distinct, as (id, label=1)."""
    parts = [account_ids(df) for df in (labelled, blacklist) if df is not None]
    if not parts:
        raise ValueError("label_set needs at least one account list")
    ids = parts[0]
    for other in parts[1:]:
        ids = ids.unionByName(other)
    return ids.distinct().withColumn("label", F.lit(1))


def seed_frame(seeds: DataFrame) -> DataFrame:
    """Seeds as DataFrame[seed_id], distinct and non-null."""
    col = "seed_id" if "seed_id" in seeds.columns else None
    return account_ids(seeds, col).withColumnRenamed("id", "seed_id").distinct()


def gate_seeds(seeds: DataFrame, labels: DataFrame | None,
               require_labelled: bool = True,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               seeds_bound: int | None = None) -> DataFrame:
    """C3 — keep only seeds present in the label set.

    The label set is streamed through a semi join against the seed list,
    broadcast when its size is proven small (``seeds_bound``: a known upper
    bound on the seed rows, else a bounded count), so the label set is never
    shuffled whole against a handful of seeds.
    """
    s = seed_frame(seeds)
    if not require_labelled:
        return s
    if labels is None:
        raise ValueError("require_labelled=True needs a label set")
    ids = labels.select(F.col("id").alias("seed_id"))
    small, _ = bounded_broadcast(s, max_broadcast_rows, seeds_bound)
    return ids.join(small, "seed_id", "left_semi").distinct()


def flag(neighbours: DataFrame, blacklist: DataFrame,
         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C8 — add ``isInBlackListResult``: is the neighbour id on the blacklist.

    Duplicate blacklist rows do not multiply neighbours (distinct hits). When
    the neighbour id set is small (checked), the blacklist is streamed once
    through a semi join against the broadcast ids and only the hits (at most
    one per neighbour id) are broadcast back; otherwise a shuffle left join.
    """
    bl = account_ids(blacklist)
    ids = neighbours.select("id").distinct()
    # the neighbour rows bound the distinct ids: no shuffle to size the ids
    small_ids, is_small = bounded_broadcast(ids, max_broadcast_rows,
                                            rows_bound(neighbours))
    if is_small:
        hits = F.broadcast(bl.join(small_ids, "id", "left_semi").distinct()
                           .withColumn("_hit", F.lit(True)))
    else:
        hits = bl.distinct().withColumn("_hit", F.lit(True))
    out = neighbours.join(hits, "id", "left")
    cols = [c for c in neighbours.columns]
    return out.select(*cols, F.col("_hit").isNotNull().alias(FLAG))


def black_neighbours(flagged: DataFrame) -> DataFrame:
    """C19 part — the blacklisted neighbours only."""
    return flagged.where(F.col(FLAG)).select("seed_id", "id", "label")


def blacklist_ratio(flagged: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """C10 — per seed: blacklisted rows, all rows, share (null when no rows).

    With ``seeds`` every seed gets a row, also one without neighbours.
    """
    per_seed = flagged.groupBy("seed_id").agg(
        F.count_if(F.col(FLAG)).alias("black_count"),
        F.count(F.lit(1)).alias("total_count"))
    if seeds is not None:
        per_seed = seed_frame(seeds).join(per_seed, "seed_id", "left").select(
            "seed_id",
            F.coalesce("black_count", F.lit(0)).cast("long").alias("black_count"),
            F.coalesce("total_count", F.lit(0)).cast("long").alias("total_count"))
    return per_seed.withColumn("ratio", safe_ratio("black_count", "total_count"))
