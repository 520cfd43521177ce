"""Hourly flows of every account, stored once per ledger (C11-C13).

``flow_cube`` keeps one row per (account, direction, hour): exact total and
number of transfers, with map-side combine before its shuffle. Trends, account
flows and recent totals join the accounts they ask for with this table and never
read the ledger; where those accounts are stored small enough to be broadcast,
only the parts (by hash of the account) that hold them are read.

Hours are epoch hours. A zone's buckets can be built from them if its offset is
a whole number of hours; for others give ``step`` = 1800 or 900 seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.functions.amounts import amount_sum_exact
from hoplens.functions.time import bucket, in_window
from hoplens.operators.flows import DIRECTIONS, TREND_UNITS, _lagged, tracked_accounts
from hoplens.operators.labels import FLAG, seed_frame

HOUR = 3600


@dataclass
class FlowCube:
    rows: DataFrame
    parts: int
    step: int


def _part(parts: int):
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def hourly(ledger: DataFrame, amount_scale: int | None = None, step: int = HOUR) -> DataFrame:
    """(id, direction, hour, total, count) of ``ledger``; rows without a timestamp
    are left out. Hour and amount are made once per transfer, before it becomes
    two sides."""
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias("id")) for d in DIRECTIONS]))
    amount = F.col("value") if amount_scale is None else F.col("value").cast(f"decimal(38,{amount_scale})")
    return (ledger.where(F.col("timestamp").isNotNull() & F.coalesce("from", "to").isNotNull())
            .select("from", "to", (F.floor(F.col("timestamp") / step) * step).alias("hour"), amount.alias("value"))
            .select(sides.alias("s"), "hour", "value")
            .where("s.id is not null").groupBy("s.id", "s.direction", "hour")
            .agg(amount_sum_exact("value", amount_scale).alias("total"), F.count(F.lit(1)).alias("count")))


def build_cube(ledger: DataFrame, path: str, amount_scale: int | None = None, step: int = HOUR,
               parts: int = 16) -> FlowCube:
    """Store the cube of ``ledger`` under ``path``. Rows without a timestamp are
    left out, as every trend leaves them out. A part that is too large is
    written in several files; readers prune by the part alone, so no order by
    account is made inside it."""
    (hourly(ledger, amount_scale, step).withColumn("part", _part(parts)).hint("rebalance", "part")
     .write.mode("overwrite").partitionBy("part").parquet(path))
    kind = "double" if amount_scale is None else f"decimal(38,{amount_scale})"
    return open_cube(ledger.sparkSession, path, kind, step, parts)


def open_cube(spark, path: str, kind: str, step: int = HOUR, parts: int = 16) -> FlowCube:
    """A cube that ``build_cube`` stored; ``kind`` is the type of its totals."""
    schema = f"id string, direction string, hour long, total {kind}, count long, part int"
    return FlowCube(spark.read.schema(schema).parquet(path), parts, step)


def flows_of(cube: FlowCube, accounts: DataFrame) -> DataFrame:
    """The cube's rows of ``accounts`` (keys..., id), stored or small."""
    wanted = accounts.withColumn("part", _part(cube.parts)).where(F.col("part") >= 0)
    return cube.rows.join(wanted, ["part", "id"]).drop("part")


def cube_trend(cube: FlowCube, accounts: DataFrame, unit: str = "day", keys: Sequence[str] = ("seed_id",),
               tz: str | None = None) -> DataFrame:
    """C12/C13 — the rows of ``flows.trend`` from the cube. ``keys`` are columns
    of ``accounts`` (``id`` may be one); direction is always a key."""
    try:
        names, units, lag_name = TREND_UNITS[unit]
    except KeyError:
        raise ValueError(f"unit must be one of {sorted(TREND_UNITS)}, not {unit!r}")
    keys = [*keys, "direction"]
    rows = flows_of(cube, accounts).select(
        *keys, *[bucket("hour", u, tz).alias(n if n != "hour" else "_hour") for n, u in zip(names, units)],
        "total", "count")
    if "_hour" in rows.columns:
        rows = rows.withColumnRenamed("_hour", "hour")
    total = rows.groupBy(*keys, *names).agg(F.sum("total").cast("double").alias("total_amount"),
                                            F.sum("count").alias("count"))
    return _lagged(total, keys, names, lag_name)


def cube_recent(cube: FlowCube, flagged: DataFrame, start: int | None, end: int | None,
                seeds: DataFrame | None = None) -> DataFrame:
    """C11 — the rows of ``flows.recent_summary`` from the cube; the bounds must
    be bounds of its hours."""
    for bound in (start, end):
        if bound is not None and bound % cube.step:
            raise ValueError(f"bounds must be multiples of {cube.step}; use flows.recent_summary for others")
    black = tracked_accounts(flagged.where(F.col(FLAG)), ("seed_id",))
    rows = flows_of(FlowCube(cube.rows.where(in_window("hour", start, end)), cube.parts, cube.step), black)
    out = rows.groupBy("seed_id").agg(F.sum("total").cast("double").alias("total_amount"),
                                      F.sum("count").alias("tx_count"))
    if seeds is None:
        return out
    return seed_frame(seeds).join(out, "seed_id", "left").select(
        "seed_id", "total_amount", F.coalesce("tx_count", F.lit(0)).cast("long").alias("tx_count"))
