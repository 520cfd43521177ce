"""C19 — one summary row per seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.functions.amounts import safe_ratio
from hoplens.operators.labels import FLAG, seed_frame


def seed_report(flagged: DataFrame, summary: DataFrame, seeds: DataFrame,
                hops: int = 4) -> DataFrame:
    """Per seed: rows per hop, all rows, blacklisted rows, their share, and the
    recent totals of ``recent_summary``. Seeds without neighbours get zeros."""
    counts = flagged.groupBy("seed_id").agg(
        *[F.count_if(F.col("label") == h).alias(f"hop{h}_count") for h in range(1, hops + 1)],
        F.count(F.lit(1)).alias("neighbour_count"),
        F.count_if(F.col(FLAG)).alias("black_count"))
    zero = [f"hop{h}_count" for h in range(1, hops + 1)] + ["neighbour_count", "black_count"]
    out = seed_frame(seeds).join(counts, "seed_id", "left")
    out = out.select("seed_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])
    out = out.withColumn("ratio", safe_ratio("black_count", "neighbour_count"))
    s = summary.select("seed_id", "total_amount", "tx_count")
    return out.join(s, "seed_id", "left").select(
        *out.columns, "total_amount", F.coalesce("tx_count", F.lit(0)).cast("long").alias("tx_count"))
