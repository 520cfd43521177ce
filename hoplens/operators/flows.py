"""Transactions and flow aggregates of accounts (C9, C11, C12, C13).

Everything starts from ``account_flows``: the ledger rows in which a tracked
account is the sender (direction 'from') or the receiver (direction 'to').
The ledger is scanned once and each row is exploded into its two sides, then
joined on the account to the tracked set (broadcast when its size is proven
small). A self-transfer of a tracked account, or a transfer between two
tracked accounts, is therefore listed once per side (bag semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplens.functions.amounts import amount_sum, amount_sum_exact, exact_sum
from hoplens.functions.time import bucket, in_window, wall_clock
from hoplens.operators.labels import FLAG, seed_frame
from hoplens.plans.strategy import (DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast, materialize,
                                    rows_bound, shuffle_join)

DIRECTIONS = ("from", "to")

# Fixed names of the trend columns per granularity: bucket column(s) and the
# name of the previous-bucket count.
TREND_UNITS = {
    "day": (("date",), ("day",), "yesterday_count"),
    "hour": (("hour",), ("hour",), "lasthour_count"),
    "month": (("month",), ("month",), "lastmonth_count"),
    "hour_of_day": (("date", "hour"), ("day", "hour_of_day"), "lasthour_count"),
}


def tracked_accounts(df: DataFrame, keys: Sequence[str] = ("seed_id",)) -> DataFrame:
    """Distinct (keys..., id) of a neighbour / seed frame."""
    if "id" not in df.columns and "seed_id" in df.columns:
        df = df.withColumn("id", F.col("seed_id"))
    return df.select(*keys, "id").where(F.col("id").isNotNull()).distinct()


def seed_accounts(seeds: DataFrame) -> DataFrame:
    """The seeds themselves as tracked accounts (seed_id, id=seed)."""
    return seed_frame(seeds).select("seed_id", F.col("seed_id").alias("id"))


def account_flows(ledger: DataFrame, accounts: DataFrame,
                  directions: Sequence[str] = DIRECTIONS,
                  start: int | None = None, end: int | None = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                  columns: Sequence[str] = ("timestamp", "from", "to", "value"),
                  accounts_bound: int | None = None) -> DataFrame:
    """Ledger rows touching tracked accounts, one row per matching side.

    ``accounts``: (keys..., id), optionally with a ``direction`` column that
    restricts an account to one side. Output: keys..., id, direction, then
    ``columns`` of the ledger row. ``start``/``end`` restrict the time window
    before the join (pushed into the scan). One scan of the ledger serves both
    sides. ``accounts_bound``: a known upper bound on the account rows.
    """
    for d in directions:
        if d not in DIRECTIONS:
            raise ValueError(f"direction must be 'from' or 'to', not {d!r}")
    columns = list(columns)
    rows = ledger
    if start is not None or end is not None:
        rows = rows.where(in_window("timestamp", start, end))
    sides = [F.struct(F.lit(d).alias("direction"), F.col(d).alias("acct")) for d in directions]
    side = F.explode(F.array(*sides)) if len(sides) > 1 else sides[0]
    exploded = rows.select(*columns, side.alias("s")).select(
        *columns, F.col("s.direction").alias("direction"),
        F.col("s.acct").alias("id")).where(F.col("id").isNotNull())
    acc, is_small = bounded_broadcast(accounts, max_broadcast_rows, accounts_bound)
    on = ["id", "direction"] if "direction" in accounts.columns else ["id"]
    keys = [c for c in accounts.columns if c not in ("id", "direction")]
    if is_small:
        joined = exploded.join(acc, on)
    else:  # a hot account's rows are spread by the row's own columns
        joined = shuffle_join(exploded, accounts, on, spread=tuple(columns))
    return joined.select(*keys, "id", "direction", *columns)


def transactions(ledger: DataFrame, accounts: DataFrame, tz: str | None = None,
                 start: int | None = None, end: int | None = None,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                 accounts_bound: int | None = None, typed: bool = False) -> DataFrame:
    """C9 — transactions of tracked accounts, sender side ∪ receiver side.

    Output: keys..., id, timestamp (epoch seconds), time ('yyyy-MM-dd HH:mm:ss'
    in ``tz`` or the session zone), from, to, value; with ``typed`` also ``at``,
    the time as a timestamp (the wall clock in ``tz``, or the instant).
    """
    flows = account_flows(ledger, accounts, DIRECTIONS, start, end, max_broadcast_rows,
                          accounts_bound=accounts_bound)
    keys = [c for c in accounts.columns if c != "id"]
    return _as_transactions(flows, keys, tz, typed)


def _as_transactions(flows: DataFrame, keys: Sequence[str], tz: str | None, typed: bool) -> DataFrame:
    at = [wall_clock("timestamp", tz).alias("at")] if typed else []
    return flows.select(*keys, "id", "timestamp", bucket("timestamp", "datetime", tz).alias("time"),
                        "from", "to", "value", *at)


def store_touching(ledger: DataFrame, accounts: DataFrame, path: str, parts: int = 16,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> None:
    """C9 in two tables under ``path``: ``rows``, the ledger rows that touch any
    account of ``accounts`` (seed_id, id), once per account and side and laid out
    by a hash of the account; and ``accounts``, the (seed_id, id) themselves. Rows
    don't multiply with the seeds that share an account. ``accounts`` is stored."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    ids = accounts.select("id").distinct()
    rows = account_flows(ledger, ids, max_broadcast_rows=max_broadcast_rows, accounts_bound=rows_bound(accounts))
    for name, df, order in (("rows", rows, ["part", "id", "timestamp"]), ("accounts", accounts.distinct(), ["part", "id"])):
        (df.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions(*order)
         .write.mode("overwrite").partitionBy("part").parquet(f"{path.rstrip('/')}/{name}"))


def touching_transactions(spark, path: str, seeds: DataFrame | None = None, tz: str | None = None,
                          typed: bool = False) -> DataFrame:
    """The rows of ``transactions`` for every seed (or those of ``seeds``) from
    the tables of ``store_touching``: a join on the account and its part, which
    prunes the parts that are read where the accounts are few."""
    base = path.rstrip("/")
    rows = spark.read.schema("id string, direction string, timestamp long, `from` string, `to` string, "
                             "value double, part int").parquet(f"{base}/rows")
    accounts = spark.read.schema("seed_id string, id string, part int").parquet(f"{base}/accounts")
    if seeds is not None:
        accounts = accounts.join(seed_frame(seeds), "seed_id", "left_semi")
    joined = rows.join(accounts.where("part >= 0"), ["part", "id"])
    return _as_transactions(joined, ["seed_id"], tz, typed)


def trend(flows: DataFrame, unit: str = "day", keys: Sequence[str] | None = None,
          tz: str | None = None, amount_scale: int | str | None = None) -> DataFrame:
    """C12/C13 — per bucket: total_amount, count, previous count, growth.

    ``flows`` comes from ``account_flows``. ``keys`` default to every column
    before ``id`` plus ``direction``. The previous count is the previous bucket
    *that has rows* within the same keys (no calendar spine), null for the
    first. Rows without a timestamp are dropped before grouping. ``amount_scale``
    is a number of places (decimal sums), None (doubles), or "exact" for sums of
    doubles that do not depend on the order (``amounts.exact_sum``).

    Scale: the group-by runs partial aggregation before its shuffle, and the
    window is partitioned by the keys, each partition holding at most one row
    per bucket of the window (days or hours), never a whole ledger.
    """
    try:
        names, units, lag_name = TREND_UNITS[unit]
    except KeyError:
        raise ValueError(f"unit must be one of {sorted(TREND_UNITS)}, not {unit!r}")
    if keys is None:
        keys = [c for c in flows.columns[:flows.columns.index("id")]] + ["direction"]
    keys = list(keys)
    f = flows.where(F.col("timestamp").isNotNull())
    f = f.select(*keys, *[bucket("timestamp", u, tz).alias(n) for n, u in zip(names, units)],
                 "value")
    if amount_scale == "exact":
        g = exact_sum(f, [*keys, *names])
    else:
        g = f.groupBy(*keys, *names).agg(amount_sum("value", amount_scale).alias("total_amount"),
                                         F.count(F.lit(1)).alias("count"))
    return _lagged(g, keys, names, lag_name)


def _lagged(g: DataFrame, keys: list[str], names: Sequence[str], lag_name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*names)
    g = g.withColumn(lag_name, F.lag("count").over(w))
    return g.select(*keys, *names, "total_amount", "count", lag_name,
                    (F.col("count") - F.col(lag_name)).alias("growth"))


def trends(flows: DataFrame, units: Sequence[str] = ("day", "hour"),
           keys: Sequence[str] | None = None, tz: str | None = None,
           amount_scale: int | None = None, materialize_base: bool = True
           ) -> dict[str, DataFrame]:
    """Several granularities from one pass over the flow rows.

    The rows are aggregated once per hour bucket (partial aggregation before
    the shuffle); that small table (at most keys x hours) is materialised and
    rolled up to days and months. Decimal sums (``amount_scale``) stay exact
    through the roll-up; double sums are re-associated.
    """
    if keys is None:
        keys = [c for c in flows.columns[:flows.columns.index("id")]] + ["direction"]
    keys = list(keys)
    f = flows.where(F.col("timestamp").isNotNull())
    base = (f.select(*keys, bucket("timestamp", "hour", tz).alias("_h"), "value")
             .groupBy(*keys, "_h")
             .agg(amount_sum_exact("value", amount_scale).alias("_sum"),
                  F.count(F.lit(1)).alias("count")))
    if materialize_base:
        base = materialize(base, name="hourly")
    out = {}
    for unit in units:
        try:
            names, _, lag_name = TREND_UNITS[unit]
        except KeyError:
            raise ValueError(f"unit must be one of {sorted(TREND_UNITS)}, not {unit!r}")
        if unit == "hour":
            g = base.select(*keys, F.col("_h").alias("hour"), "_sum", "count")
        elif unit == "hour_of_day":
            g = base.select(*keys, F.substring("_h", 1, 10).alias("date"),
                            F.substring("_h", 12, 2).alias("hour"), "_sum", "count")
        else:
            width = 10 if unit == "day" else 7
            g = (base.groupBy(*keys, F.substring("_h", 1, width).alias(names[0]))
                     .agg(F.sum("_sum").alias("_sum"), F.sum("count").alias("count")))
        g = g.withColumn("total_amount", F.col("_sum").cast("double")).drop("_sum")
        out[unit] = _lagged(g, keys, names, lag_name)
    return out


def neighbour_flows(ledger: DataFrame, flagged: DataFrame,
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Flows of the distinct flagged neighbour ids of each seed.

    Keys: seed_id, isInBlackListResult. An id found at several hops counts
    once per seed.
    """
    acc = tracked_accounts(flagged, ("seed_id", FLAG))
    return account_flows(ledger, acc, max_broadcast_rows=max_broadcast_rows,
                         accounts_bound=rows_bound(flagged))


def neighbour_trend(ledger: DataFrame, flagged: DataFrame, unit: str = "day",
                    tz: str | None = None, amount_scale: int | None = None,
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C12 — {blacklisted, other} x {from, to} trend of every seed in one frame."""
    flows = neighbour_flows(ledger, flagged, max_broadcast_rows)
    return trend(flows, unit, ("seed_id", FLAG, "direction"), tz, amount_scale)


def account_trend(ledger: DataFrame, seeds: DataFrame, unit: str = "day",
                  tz: str | None = None, amount_scale: int | None = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C13 — trend of the seed accounts themselves, per direction."""
    flows = account_flows(ledger, seed_accounts(seeds), max_broadcast_rows=max_broadcast_rows)
    return trend(flows, unit, ("seed_id", "direction"), tz, amount_scale)


def neighbour_account_trend(ledger: DataFrame, flagged: DataFrame, unit: str = "day",
                            tz: str | None = None, amount_scale: int | None = None,
                            max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C13 for every neighbour: its own trend per direction, keyed by
    (seed_id, id) — one plan for all neighbours of all seeds."""
    acc = tracked_accounts(flagged, ("seed_id",))
    flows = account_flows(ledger, acc, max_broadcast_rows=max_broadcast_rows,
                          accounts_bound=rows_bound(flagged))
    return trend(flows, unit, ("seed_id", "id", "direction"), tz, amount_scale)


def recent_summary(ledger: DataFrame, flagged: DataFrame, start: int | None,
                   end: int | None, seeds: DataFrame | None = None,
                   amount_scale: int | None = None,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C11 — per seed: total value and number of transactions of its
    blacklisted neighbours inside ``[start, end)`` (sender ∪ receiver side).

    With ``seeds`` every seed gets a row (null total, zero count when empty).
    """
    black = tracked_accounts(flagged.where(F.col(FLAG)), ("seed_id",))
    flows = account_flows(ledger, black, DIRECTIONS, start, end, max_broadcast_rows,
                          accounts_bound=rows_bound(flagged))
    agg = flows.groupBy("seed_id").agg(amount_sum("value", amount_scale).alias("total_amount"),
                                       F.count(F.lit(1)).alias("tx_count"))
    if seeds is None:
        return agg
    return seed_frame(seeds).join(agg, "seed_id", "left").select(
        "seed_id", "total_amount", F.coalesce("tx_count", F.lit(0)).cast("long").alias("tx_count"))
