"""Writing results (K1-K7).

* save modes replace the driver-side ``rmtree`` / path checks: 'errorifexists'
  (default), 'overwrite' (replace), 'ignore' (skip when present), and
  'missing': add only the keys (e.g. seed / neighbour folders, or the rows
  of seeds in a report) that are not complete yet. Each attempt writes a folder
  of its own; a commit record per key follows the rows. What a lost job left
  half-written has no record: it is ignored (``read_committed``) and its keys are
  written again;
* ``partition_by`` lays out per-seed / per-neighbour folders in one write
  (``seed_id=<seed>/id=<neighbour>/``) instead of one job per account; rows are
  first brought together by those keys (a key that is too large is split), so
  a folder gets few files;
* ``single_file`` gathers the rows of small reports, after their last stage,
  in one partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hoplens.functions.amounts import percent_text
from hoplens.plans.strategy import materialize

SAVE_MODES = ("errorifexists", "error", "overwrite", "ignore", "append", "missing")


def commits_path(path: str) -> str:
    """Where the commit records of an output lie, beside it."""
    return f"{path.rstrip('/')}.commits"


def committed(spark, path: str, keys: Sequence[str]) -> DataFrame | None:
    """(attempt, keys...) of the finished attempts of an output (None without)."""
    schema = ", ".join(["attempt string", *(f"`{k}` string" for k in keys)])
    try:
        return spark.read.schema(schema).parquet(commits_path(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(done: DataFrame, path: str, keys: Sequence[str], attempt: str) -> None:
    """Record that ``attempt`` wrote all rows of the keys in ``done``. One file,
    which appears at once when its job commits, after the rows."""
    rows = done.select(F.lit(attempt).alias("attempt"), *[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    rows.repartition(1).write.mode("append").parquet(commits_path(path))


def read_committed(spark, path: str, schema, keys: Sequence[str], fmt: str = "parquet", header: bool = True) -> DataFrame:
    """The rows of finished attempts, with their attempt; rows that a lost job
    left behind have no commit record for their key and are not seen."""
    reader = spark.read.schema(StructType([*schema.fields, StructField("attempt", StringType())])).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header)
    rows = reader.load(path)
    done = committed(spark, path, keys)
    if done is None:
        return rows.where("false")
    cond = [rows["attempt"] == done["attempt"], *[rows[k].cast("string").eqNullSafe(done[k]) for k in keys]]
    return rows.join(done, cond, "left_semi")


def pending_keys(wanted: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of ``wanted`` (distinct keys) that no finished attempt holds."""
    done = committed(wanted.sparkSession, path, keys)
    if done is None:
        return wanted
    return wanted.join(done, [wanted[k].cast("string").eqNullSafe(done[k]) for k in keys], "left_anti")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] | None = None, single_file: bool = False,
                header: bool = True, keys: Sequence[str] | None = None,
                done: DataFrame | None = None, attempt: str | None = None) -> None:
    """Write ``df``. Mode 'missing' adds the rows of ``keys`` (by default
    ``partition_by``) that no finished attempt holds, in a folder of its own
    (``attempt=<id>``), and then records the keys as complete: those of ``df``, or
    those of ``done`` where keys without rows are complete too. An output without
    keys is written anew."""
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {SAVE_MODES}, not {mode!r}")
    keys = list(keys or partition_by or ())
    record = None
    if mode == "missing":
        mode = "errorifexists" if keys else "overwrite"
        if keys:
            attempt = attempt or uuid.uuid4().hex
            new = pending_keys(df.select(*keys).distinct(), path, keys) if done is None else done
            record = materialize(new.select(*keys).distinct(), name="pending")
            df = df.join(record, [df[k].eqNullSafe(record[k]) for k in keys], "left_semi")
    target = f"{path.rstrip('/')}/attempt={attempt}" if record is not None else path
    if single_file:
        df = df.repartition(1)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target)
    if record is not None:
        commit(record, path, keys, attempt)


def with_percent(df: DataFrame, ratio_col: str = "ratio", name: str = "percent") -> DataFrame:
    """Add the report's ``"12.34%"`` text next to a numeric ratio."""
    return df.withColumn(name, percent_text(ratio_col))
