"""Physical-plan choices shared by the operators.

* ``bounded_broadcast`` — broadcast a join side only after proving its size:
  the row count is checked against a limit (the side is materialised first,
  so the check reads checkpoint files, not the whole lineage). Above the limit
  ``shuffle_join`` joins by shuffling: AQE's skew-join split handles a hot key,
  or, when that rule is off, an explicit deterministic salt.
* ``materialize`` — cut lineage in the shared folder named by
  ``spark.checkpoint.dir``: a Parquet table written once and read back
  (``checkpoint()`` would run the frame's last stage twice: once for the
  action and once more to write the files). The data survives executor loss
  and later stages do not recompute earlier hops.
* ``sieved`` — rows whose key cannot match are stopped by a bit table of bounded
  size before a shuffle join, so the ledger rows that enter its exchange are
  close to those that match.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.plans.stages import active_store
from hoplens.session import checkpoint_dir

# Broadcast limit in rows for id-sized sides: up to three account strings of
# ~42 characters (about 200 bytes a row with overhead), so ~200 MB per executor.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def rows_bound(df: DataFrame) -> int:
    """Row count of ``df``, counted per partition (a limit would send its rows
    to one task). On a materialised frame Parquet footers answer it; it bounds
    any projection or distinct of the frame."""
    return df.count()


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      known_bound: int | None = None) -> tuple[DataFrame, bool]:
    """Return (side, broadcast?) with a broadcast hint only for a proven size.

    The bound comes from the caller (``known_bound``, e.g. seeds x cap for a
    capped frontier, or the rows of the frame a distinct comes from); where it
    is absent or above the limit the rows of ``df`` itself are counted.
    """
    if max_rows <= 0:
        return df, False
    if known_bound is not None and known_bound <= max_rows:
        return F.broadcast(df), True
    return (F.broadcast(df), True) if rows_bound(df) <= max_rows else (df, False)


# Salts of the explicit skew split (used only when AQE's split is off).
DEFAULT_SALTS = 16


def aqe_splits_skew(spark) -> bool:
    """True when AQE and its skew-join rule are on for this session."""
    def on(key: str) -> bool:
        return str(spark.conf.get(key, "true")).lower() == "true"
    return on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled")


# Longs in the bit table of ``sieved``: 64 million bits, some 50 MB in a task at most.
CELLS = 1 << 20


def sieved(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``big`` without most of the rows whose key does not occur in ``small``;
    none that occurs is lost. One bit for each hash of a key, in a table of at
    most CELLS longs whatever the input, which is broadcast; n keys let about n
    in 64 * CELLS other rows pass."""
    spot = F.pmod(F.xxhash64(*on), F.lit(64 * CELLS))
    cell, bit = F.shiftright(spot, 6).alias("_cell"), F.pmod(spot, F.lit(64)).cast("int").alias("_bit")
    bits = small.select(cell, bit).groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return (big.select("*", cell, bit).join(F.broadcast(bits), "_cell")
            .where(F.getbit("_bits", "_bit") == 1).select(*big.columns))


def shuffle_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                 spread: tuple[str, ...] = (), salts: int = DEFAULT_SALTS, sieve: bool = True) -> DataFrame:
    """Shuffle join where one key of ``big`` may hold a large share of its rows.

    With AQE's skew-join rule on, a plain join: AQE splits an oversized
    partition at run time. Otherwise the split is explicit and deterministic:
    each ``big`` row gets a salt from a hash of its ``spread`` columns and its
    input partition (so even exact copies of one row, spread over many input
    splits, land on different salts; recomputing a split gives the same salts)
    and each ``small`` row is replicated once per salt, so a hot key is spread
    over ``salts`` tasks. Every ``big`` row meets each matching ``small`` row
    exactly once, so inner, left-outer and left-semi results are unchanged.
    Inner and semi joins sieve ``big`` first, unless nearly all of it matches.
    """
    if sieve and how in ("inner", "left_semi"):
        big = sieved(big, small, on)
    if not spread or aqe_splits_skew(big.sparkSession):
        return big.join(small, on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread], F.spark_partition_id()), F.lit(salts))
    salted = big.withColumn("_salt", salt)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, list(on) + ["_salt"], how).drop("_salt")


def stage_path(spark, name: str) -> str:
    """A new path for a stage that writes itself: in the job's store, if any."""
    store = active_store()
    if store is not None:
        return store.path(name)
    return f"{checkpoint_dir(spark).rstrip('/')}/hoplens-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, enabled: bool = True, name: str = "stage") -> DataFrame:
    """Cut lineage in the shared folder (never a local checkpoint): the frame is
    written once as a Parquet table and read back, so it is computed once, is
    columnar and has real file sizes for the planner. Inside a ``StageStore``
    the table belongs to the job's stages."""
    if not enabled:
        return df
    store = active_store()
    if store is not None:
        return store.table(df, name)
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no inference job
