"""Session helpers: recommended settings and the checkpoint folder.

The library never builds a session behind the caller's back; these helpers
are for scripts, tests and the benchmark. ``checkpoint_dir`` is the one
function the operators call: it reads ``spark.checkpoint.dir`` from the
session and only invents a folder when the setting is absent on a local
master (in the warehouse folder, as in tests), never on a cluster.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces small
# shuffle partitions at run time, and splits skewed join partitions (an
# exchange account can own a large share of all transfers).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app_name: str = "hoplens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_master(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # Spark Connect: no SparkContext on the client
        return str(spark.conf.get("spark.master", "")).startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    On a cluster it must be set (HDFS, object store). For a local master where
    it is absent, as in tests, it is a folder of the session's warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        except Exception:
            root = None
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()  # set by the caller
            if root and "/hoplens-" in root:  # by checkpoint_dir below
                root = root[:root.index("/hoplens-" + spark.conf.get("spark.app.id", "app"))]
        except Exception:
            root = None
    if not root:
        if not _local_master(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) so materialised stages survive executor loss")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/hoplens-checkpoints"
    return root


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder for lineage cuts, in the shared folder."""
    root = shared_root(spark)
    app = spark.conf.get("spark.app.id", "app")
    folder = f"{root.rstrip('/')}/hoplens-{app}"
    try:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)  # also serves df.checkpoint() callers
    except Exception:
        pass
    return folder
