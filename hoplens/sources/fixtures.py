"""Views over the shared test tables (definitions in FIXTURES.md).

The tables are TPC-H-like: an order line becomes a transfer from the
ordering customer to the part, customers and parts sharing one account
namespace ``'a' || key``. The views are plain Spark plans over the Parquet
files; ``ledger_table`` additionally stores the year's ledger once per
application in the checkpoint folder (the analyses then scan a Parquet ledger
clustered by time, as they would in production).
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hoplens.functions.time import timestamp_to_epoch
from hoplens.operators.adjacency import Graph, build_graph, open_graph
from hoplens.operators.clean import clean_ledger, time_window, write_clean_ledger
from hoplens.operators.cube import FlowCube, build_cube, open_cube
from hoplens.session import checkpoint_dir

# Fixed values of the fixture definition (epoch seconds, UTC).
YEAR_START = 873072000      # 1997-09-01 00:00
YEAR_END = 904608000        # 1998-09-01 00:00
RECENT_START = 901929600    # 1998-08-01 00:00
RECENT_END = YEAR_END
N_BLACK_SEEDS = 5           # blacklisted seeds: the five smallest customer keys
STAR_ROLES = 3              # seeds 1..3 centre the two-way, out and sampled stars
COMPONENT = 1               # component whose labelled accounts are listed

_lock = threading.RLock()  # a stored table may be built from another one
_stored: dict[tuple[str, str], str] = {}


def account(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("a"), col.cast("string"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as transfers: timestamp, from, to, value."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_discount", "l_extendedprice", "l_shipdate")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ts = timestamp_to_epoch(li, "l_shipdate") + (F.col("l_orderkey") % 24) * 3600
    lines = li.select(
        ts.cast("long").alias("timestamp"), "l_orderkey", "l_partkey",
        F.when(F.col("l_discount") == 0, F.lit(0.0))
         .otherwise(F.col("l_extendedprice")).cast("double").alias("value"))
    # keys travel as longs; a window on the timestamp is applied before the join
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "timestamp", account("o_custkey").alias("from"), account("l_partkey").alias("to"), "value")


def _stored_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    return spark.read.parquet(_stored_path(spark, sf_dir, name, build))


def _stored_path(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Run ``build(path)`` once per application, in the checkpoint folder."""
    key = (spark.conf.get("spark.app.id", "app"), os.path.abspath(sf_dir), name)
    with _lock:
        path = _stored.get(key)
        if path is None:
            digest = hashlib.sha1(key[1].encode()).hexdigest()[:16]
            path = f"{checkpoint_dir(spark).rstrip('/')}/hoplens-{name}-{digest}"
            build(path)
            _stored[key] = path
    return path


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of ``ledger_raw`` that every analysis reads (zero-value rows kept),
    stored once per application as Parquet sorted by time. Lines of other years
    are dropped by the scan: they are not joined, sorted or written."""
    return _stored_table(spark, sf_dir, "ledger", lambda path: write_clean_ledger(
        time_window(ledger_raw(spark, sf_dir), YEAR_START, YEAR_END), path, mode="overwrite"))


def ledger(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """The analysed ledger: one year, no zero-value rows."""
    raw = ledger_table(spark, sf_dir) if stored else ledger_raw(spark, sf_dir)
    return clean_ledger(raw, YEAR_START, YEAR_END)


def graph_edges(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """The prototype's graph: one year, zero-value rows kept."""
    raw = ledger_table(spark, sf_dir) if stored else ledger_raw(spark, sf_dir)
    return time_window(raw, YEAR_START, YEAR_END)


def transfer_graph(spark: SparkSession, sf_dir: str, kind: str = "ledger") -> Graph:
    """The stored graph of the ledger, or (``kind`` 'graph') of the prototype's
    edges, built once per application."""
    edges = ledger if kind == "ledger" else graph_edges
    path = _stored_path(spark, sf_dir, f"{kind}-pairs", lambda path: build_graph(
        edges(spark, sf_dir).select("from", "to"), path))
    return open_graph(spark, path)


def flow_cube(spark: SparkSession, sf_dir: str, amount_scale: int) -> FlowCube:
    """The stored hourly flows of the ledger, built once per application."""
    path = _stored_path(spark, sf_dir, f"cube{amount_scale}", lambda path: build_cube(
        ledger(spark, sf_dir), path, amount_scale))
    return open_cube(spark, path, f"decimal(38,{amount_scale})")


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a negative balance, as DataFrame[blacklist]."""
    c = _read(spark, sf_dir, "customer")
    return c.where(F.col("c_acctbal") < 0).select(account("c_custkey").alias("blacklist"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a negative balance, as DataFrame[account]."""
    s = _read(spark, sf_dir, "supplier")
    return s.where(F.col("s_acctbal") < 0).select(account("s_suppkey").alias("account"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component membership: customer account -> nation key."""
    c = _read(spark, sf_dir, "customer")
    return c.select(account("c_custkey").alias("id"), F.col("c_nationkey").alias("component"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed list, stored once per application like a seeds file."""
    return _stored_table(spark, sf_dir, "seeds", lambda path: seed_list(spark, sf_dir)
                         .coalesce(1).write.mode("overwrite").parquet(path))


def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataFrame[id, seed_no]: the five smallest blacklisted customer accounts,
    then the smallest customer account on neither list (it must be gated out)."""
    from hoplens.operators.labels import label_set

    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    black = (c.where(F.col("c_acctbal") < 0).orderBy("c_custkey").limit(N_BLACK_SEEDS)
             .select("c_custkey", F.lit(0).alias("grp")))
    labels = label_set(labelled(spark, sf_dir), blacklist(spark, sf_dir))
    other = (c.select("c_custkey", account("c_custkey").alias("id"))
             .join(labels.select("id"), "id", "left_anti")
             .orderBy("c_custkey").limit(1).select("c_custkey", F.lit(1).alias("grp")))
    both = black.unionByName(other)
    # both inputs are bounded by their limits (at most six rows)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("c_custkey"))
    return both.select(account("c_custkey").alias("id"),
                       (rank + F.col("grp") * N_BLACK_SEEDS).alias("seed_no"))
