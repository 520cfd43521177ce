"""Readers for the ledger and the account lists.

All readers use explicit schemas (no ``inferSchema`` pass over the data) and
return DataFrames with the library's column names:

* ledger: ``timestamp`` (epoch seconds, long), ``from``, ``to``, ``value``
  (double), plus any further raw columns;
* account lists: one ``id`` column (string).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw transfer export, 14 columns. Widened from the export's int/float to
# long/double: epoch seconds past 2038 and 18-digit values survive.
RAW_LEDGER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("from", T.StringType(), True),
    T.StructField("to", T.StringType(), True),
    T.StructField("coin", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("transHash", T.StringType(), True),
    T.StructField("gasUsed", T.DoubleType(), True),
    T.StructField("gaslimit", T.DoubleType(), True),
    T.StructField("fee", T.DoubleType(), True),
    T.StructField("fromType", T.StringType(), True),
    T.StructField("toType", T.StringType(), True),
    T.StructField("transType", T.StringType(), True),
    T.StructField("isLoop", T.IntegerType(), True),
    T.StructField("status", T.IntegerType(), True),
])

CLEAN_LEDGER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("from", T.StringType(), True),
    T.StructField("to", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
])

LEDGER_COLUMNS = ("timestamp", "from", "to", "value")


def _by_header(names: list[str], schema: T.StructType) -> T.StructType:
    missing = [c for c in LEDGER_COLUMNS if c in schema.names and c not in names]
    if missing:
        raise ValueError(f"ledger has no column {', '.join(missing)}; its header is {', '.join(names)}")
    types = {f.name: f.dataType for f in schema}
    return T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])


def read_ledger(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
                schema: T.StructType | None = None, header: bool = True,
                infer_schema: bool = False) -> DataFrame:
    """Read a ledger from ``hdfs://``, ``file://`` or default-FS paths.

    CSV takes a schema (``RAW_LEDGER_SCHEMA`` for the 14-column export,
    ``CLEAN_LEDGER_SCHEMA`` by default for the cleaned four columns);
    with a header line the columns are matched by name, other columns are read
    as text, and a ledger column that is absent is an error.
    ``infer_schema=True`` infers types instead, at the price of an extra pass
    over the files. Parquet and ORC carry their own schema.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", header)
        if infer_schema and schema is None:
            df = reader.option("inferSchema", True).csv(paths)
            if "timestamp" in df.columns:
                df = df.withColumn("timestamp", df["timestamp"].cast("long"))
            return df
        schema = schema or CLEAN_LEDGER_SCHEMA
        if header:  # columns go by their names; a file with another header fails
            schema = _by_header(reader.csv(paths).columns, schema)
            reader = reader.option("enforceSchema", False)
        return reader.schema(schema).csv(paths)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(paths)


def account_ids(df: DataFrame, column: str | None = None) -> DataFrame:
    """Reduce an account list to one string column ``id``.

    ``column`` names the account column (``blacklist`` for the blacklist,
    ``account`` for labelled accounts, ``id`` for seeds); by default the first
    of those present is used. A serial ``id`` next to ``blacklist``/``account``
    is dropped. Null accounts are removed.
    """
    if column is None:
        for candidate in ("blacklist", "account", "id", "seed_id"):
            if candidate in df.columns:
                column = candidate
                break
        else:
            column = df.columns[0]
    return df.select(F.col(column).cast("string").alias("id")).where(F.col("id").isNotNull())


def read_accounts(spark: SparkSession, path: str, column: str | None = None,
                  fmt: str = "csv", header: bool = True) -> DataFrame:
    """Read a blacklist / labelled-account / seed file as ``DataFrame[id]``."""
    if fmt == "csv":
        df = spark.read.option("header", header).csv(path)  # all strings
    else:
        df = spark.read.format(fmt).load(path)
    return account_ids(df, column)
