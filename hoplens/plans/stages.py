"""Stages with a name and a lifetime.

Inside ``with StageStore(spark, record):`` every ``materialize`` writes into one
folder that belongs to the job, in one format (Parquet), under the stage's name
and its turn. ``record`` names what the stages depend on (inputs, parameters):
a job that failed leaves the folder, and when it is run again with the same
record the finished stages are read, not computed. At the end of a job that
succeeds the folder is removed. A stage counts as finished when its
``_SUCCESS`` mark is there, which Spark writes last.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from hoplens.session import shared_root

_active: list["StageStore"] = []


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system (any scheme that Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def describe(df: DataFrame) -> list[str]:
    """What identifies an input in a record: its files with their sizes and
    times of change, and its columns."""
    spark, out = df.sparkSession, [df.schema.json()]
    for name in sorted(df.inputFiles()):
        p, fs = hadoop_path(spark, name)
        status = fs.getFileStatus(p)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return out


class StageStore:
    def __init__(self, spark: SparkSession, record: object, root: str | None = None):
        self.spark, self.turns, self.reused = spark, Counter(), 0
        self.record = json.dumps(record, sort_keys=True, default=str)
        digest = hashlib.sha256(self.record.encode()).hexdigest()[:24]
        self.folder = f"{(root or shared_root(spark)).rstrip('/')}/hoplens-stages-{digest}"

    def path(self, name: str) -> str:
        self.turns[name] += 1
        return f"{self.folder}/{name}-{self.turns[name]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        if exists(self.spark, f"{path}/_SUCCESS"):
            self.reused += 1
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "StageStore":
        _active.append(self)
        return self

    def __exit__(self, kind, *_):
        _active.remove(self)
        if kind is None:
            remove(self.spark, self.folder)


def active_store() -> StageStore | None:
    return _active[-1] if _active else None
