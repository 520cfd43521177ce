"""Helpers shared by the training-data operators.

Row identity: an operator that has to find a row again keys it by
``(_k, _dup)`` (see ``with_identity``), so null and repeated ids keep a row of
their own. Text helpers work on whole Arrow buffers; arrays are built over
pieces of bounded length, so a very long text costs memory in proportion to
its words, never to its bytes times a constant.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from hoplens.session import checkpoint_dir

MIN_LONG = -(2 ** 63)
#: Bytes of text worked on at once by the vectorised helpers.
PIECE = 1 << 20
#: Bytes of an Arrow batch, about (at least one row), that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Longs in the bit table of ``sieved``: 64 million bits, some 50 MB in a task at most.
CELLS = 1 << 20
_POWERS: dict = {}


# --- Spark side -----------------------------------------------------------

def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most about BATCH_BYTES (a
    smaller setting stays). Spark's own bound of 64 MB is reached by texts, and
    each task holds a batch three times: as it grows, in the JVM's native memory
    and in the worker. No result depends on where batches are cut."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    start from the files, and a lost executor costs no earlier step."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_identity(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Add ``_k`` (the id, null as the smallest long) and ``_dup`` (0, 1, ...
    among rows that share an id, in order of a hash of ``order``). Ids are
    unique as a rule; one pass over the id column finds out, and only rows of
    repeated ids pay for a numbering: rows are counted by (id, hash), the counts
    are summed up in ranges of the hash, and only rows that agree in id and hash
    meet in a task, so an id of any share of the rows is spread by its hashes.
    Rows that agree in ``order`` are numbered by a hash of all columns; the only
    ties left are rows without a difference."""
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG))
    out = df.withColumn("_k", k)
    repeated = out.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    if repeated.isEmpty():
        return out.withColumn("_dup", F.lit(0))
    repeated = stage(repeated, "repeated-ids")
    hashed = out.withColumn("_h", F.xxhash64(*order))
    pieces = (sieved(hashed.select("_k", "_h"), repeated, "_k").join(repeated, "_k", "left_semi")
              .groupBy("_k", "_h").agg(F.count("*").alias("_n")))
    pieces = stage(pieces.withColumn("_range", F.shiftright("_h", 52)), "identity-counts")
    before = lambda *by: F.coalesce(F.sum("_n").over(
        Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = (pieces.groupBy("_k", "_range").agg(F.sum("_n").alias("_n"))
              .select("_k", "_range", before("_k", "_range").alias("_lower")))
    base = stage(pieces.withColumn("_base", before("_k", "_range", "_h")).join(ranges, ["_k", "_range"])
                 .select("_k", "_h", (F.col("_base") + F.col("_lower")).alias("_base")), "identity")
    whole = F.struct(*df.columns)
    if any(t in df.schema.simpleString() for t in ("map<", "variant")):  # types that have no hash
        whole = F.to_json(whole)
    w = Window.partitionBy("_k", "_h").orderBy(*[F.col(c) for c in order], F.xxhash64(whole))
    several = (sieved(hashed, repeated, "_k").join(base, ["_k", "_h"], "left")
               .withColumn("_dup", (F.coalesce("_base", F.lit(0)) + F.row_number().over(w) - 1).cast("int")))
    once = unsieved(hashed, repeated, "_k").withColumn("_dup", F.lit(0))
    return once.unionByName(several.select(once.columns)).drop("_h")


def whole_rows(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """(_row, _k, _dup): all columns of ``df`` as one struct beside its
    identity, so that no helper column has the name of an input column;
    ``select("_row.*")`` gives them back."""
    return with_identity(df.select(F.struct("*").alias("_row")), f"_row.{id_col}", *[f"_row.{c}" for c in order])


def _sieve(rows: DataFrame, keys: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    spot = F.pmod(F.xxhash64(*on), F.lit(64 * CELLS))
    marks = [F.shiftright(spot, 6).alias("_sieve_cell"), F.pmod(spot, F.lit(64)).cast("int").alias("_sieve_bit")]
    bits = keys.select(*marks).groupBy("_sieve_cell").agg(F.bit_or(F.expr("shiftleft(1L, _sieve_bit)")).alias("_sieve_bits"))
    return rows.select("*", *marks).join(F.broadcast(bits), "_sieve_cell", how)


def sieved(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``rows`` without most of those whose columns ``on`` do not occur in
    ``keys``; none that occurs is lost, so a join may follow. A bit table with
    one bit for each hash, of at most CELLS longs whatever the input, goes to
    all tasks; rows that it stops never enter the join's shuffle. The more keys,
    the more rows pass it by chance (n keys: about n in 64 * CELLS)."""
    return (_sieve(rows, keys, on, "inner")
            .where(F.getbit("_sieve_bits", "_sieve_bit") == 1).select(*rows.columns))


def unsieved(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The ``rows`` that ``sieved`` stops: none of them occurs in ``keys``."""
    return _sieve(rows, keys, on, "left").where(
        "_sieve_bits is null or getbit(_sieve_bits, _sieve_bit) = 0").select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``rows`` whose columns ``on`` (not null) do not occur in ``keys`` (stored).
    Rows that the sieve stops stay where they are; only the others, the rows to
    go and few besides, are shuffled into an anti join."""
    return unsieved(rows, keys, *on).unionByName(sieved(rows, keys, *on).join(keys, list(on), "left_anti"))


#: Rows of the table that ``joined_hot`` broadcasts, at most.
HOT = 1024


def joined_hot(rows: DataFrame, values: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` left joined with ``values`` (stored, one row per key ``on``,
    with the number of rows of the key in ``count``). Keys with a 1024th of the
    counted rows, at most HOT of them, are joined by broadcast, and their rows
    are not shuffled; no other key is large."""
    total = values.agg(F.sum(count)).first()[0] or 0
    more = [c for c in values.columns if c not in on]
    hot = F.col(count) * HOT >= F.lit(total)
    large = values.where(hot).select(*on, F.struct(*more).alias("_hot"))
    first = rows.join(F.broadcast(large), on, "left")
    rest = first.where("_hot is null").drop("_hot").join(values.where(~hot), on, "left")
    return first.where("_hot is not null").select(*rows.columns, "_hot.*").unionByName(rest.select(*rows.columns, *more))


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """True if two sets of edges are equal, by their counts and hash sums."""
    def sums(e: DataFrame):
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        return e.agg(F.count("*"), F.sum(h)).first()
    return sums(a) == sums(b)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``; component = its smallest id.

    Alternating large-star and small-star steps (a logarithmic number of
    rounds in practice). Every step is a grouped minimum with map-side combine
    and a join of two stored tables, which Spark splits where a hub has a
    large share of the edges; nothing is gathered in one task.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u <> v").distinct(), "cc")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")), "cc-low")
        large = stage(both.join(low, "u").where("v > u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .where("u <> v").distinct(), "cc-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = stage(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
                      .distinct(), "cc-small")
        if same_edges(e, small):
            break
        e = small
    roots = e.select(F.col("v").alias("id")).distinct()
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(roots.select("id", F.col("id").alias("component"))))


# --- text in Arrow batches ------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)
    offs = offs[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size \
        else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def small(batches, column: int, limit: int = 1 << 20):
    """Cut Arrow batches into slices with at most about ``limit`` bytes of text
    in ``column`` (one row at least), so that the arrays built over a slice
    stay small whatever the batch."""
    for b in batches:
        offs = utf8(b.column(column))[1]
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def packed(rows: DataFrame) -> DataFrame:
    """Replace the last column, text, by its compressed bytes (z): what travels
    in a shuffle is about a third of the text."""
    names = rows.columns[:-1]

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in small(batches, len(names)):
            data, offs = utf8(b.column(len(names)))
            z = [press.compress(data[lo:hi].data) for lo, hi in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], names=[*names, "z"])

    return rows.mapInArrow(pack, StructType([*rows.schema.fields[:-1], StructField("z", BinaryType())]))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column that ``packed`` made."""
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(z) for z in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (len + 1)."""
    inside = ~SPACES[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]  # a text's first byte starts a word of its own
    starts[at] = inside[at]
    ends = inside
    ends[:-1] &= ~inside[1:] | starts[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def word_counts(column: pa.Array) -> np.ndarray:
    data, offs = utf8(column)
    return np.diff(word_bounds(data, offs)[2])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (changes a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes; powers of an odd base and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[1]) < n:
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 2 ** 64, 256, np.uint64)
        base = int(rng.integers(0, 2 ** 62)) * 2 + 1
        n = max(n, PIECE + 4096)
        grow = lambda b: np.cumprod(np.concatenate(
            [np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
        have = _POWERS[seed] = values, grow(base), grow(pow(base, -1, 2 ** 64))
    return have


def prefix_hash(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash over the bytes, for ``span_hash``."""
    values, power, inverse = _powers(seed, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hash."""
    sums, inverse = prefix
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the first word of each text (len + 1)."""
    s, e, first = word_bounds(data, offs)
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE, "right")))
        lo = s[i]
        out[i:j] = span_hash(prefix_hash(data[lo:e[j - 1]], seed), s[i:j] - lo, e[i:j] - lo)
        i = j
    return out, first
