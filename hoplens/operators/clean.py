"""C1 — clean ledger: one time window, four columns, no zero-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.functions.time import in_window
from hoplens.sources.ledger import LEDGER_COLUMNS


def clean_ledger(raw: DataFrame, start: int | None = None, end: int | None = None,
                 drop_zero: bool = True) -> DataFrame:
    """``start <= timestamp < end``, columns (timestamp, from, to, value).

    The zero test is numeric: ``value != 0`` drops zeros and nulls and keeps
    NaN. All predicates are plain column comparisons, so Catalyst pushes them
    into the Parquet scan (row-group skipping on ``timestamp``).
    """
    df = raw.select(*LEDGER_COLUMNS).where(in_window("timestamp", start, end))
    if drop_zero:
        df = df.where(F.col("value") != F.lit(0.0))
    return df


def time_window(raw: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The window alone (zero-value rows kept), as the graph prototype reads it."""
    return raw.where(in_window("timestamp", start, end))


def write_daily_ledger(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Store a ledger in one folder a day (``day``, days since 1970 in UTC), sorted
    by time in each file. Rows of a day are brought together; a day that is too
    large is written in several files. Rows without a timestamp have their own
    folder, which no window opens."""
    day = F.floor(F.col("timestamp") / 86400).cast("int")
    (df.withColumn("day", day).hint("rebalance", "day").sortWithinPartitions("day", "timestamp")
     .write.mode(mode).format(fmt).partitionBy("day").save(path))


def read_daily_ledger(spark, path: str, start: int | None = None, end: int | None = None,
                      fmt: str = "parquet") -> DataFrame:
    """The window ``start <= timestamp < end`` of a ledger that
    ``write_daily_ledger`` stored; only the folders of its days are opened."""
    df = spark.read.format(fmt).load(path)
    days = in_window("day", None if start is None else start // 86400, None if end is None else -(-end // 86400))
    return df.where(days & in_window("timestamp", start, end)).drop("day")


def write_clean_ledger(df: DataFrame, path: str, mode: str = "errorifexists",
                       fmt: str = "parquet") -> None:
    """Store a cleaned ledger for the analyses, sorted by time inside each file.

    Cleaning is narrow, so nothing is shuffled: each task writes what it read,
    and files keep the time order in which the export came. Sorting inside
    each file keeps the row-group min/max statistics on ``timestamp`` tight,
    so a later window filter skips files and row groups. CSV files get a
    header line.
    """
    writer = df.sortWithinPartitions("timestamp").write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
