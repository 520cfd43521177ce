"""Amount aggregation and display helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amount_sum(c: Column | str, scale: int | None = None) -> Column:
    """Sum of transfer values.

    ``scale=None`` sums doubles, as the ledger stores them. With a scale the
    values are summed as ``decimal(38, scale)`` and returned as double: the sum
    is then exact and independent of the order in which partitions combine,
    so reruns after an executor loss give bit-identical totals.
    """
    col = F.col(c) if isinstance(c, str) else c
    if scale is None:
        return F.sum(col)
    return F.sum(col.cast(f"decimal(38,{scale})")).cast("double")


def amount_sum_exact(c: Column | str, scale: int | None = None) -> Column:
    """Like ``amount_sum`` but keeps the decimal type (for later roll-ups)."""
    col = F.col(c) if isinstance(c, str) else c
    if scale is None:
        return F.sum(col)
    return F.sum(col.cast(f"decimal(38,{scale})"))


def exact_sum(df: DataFrame, keys: Sequence[str], value: str = "value", total: str = "total_amount",
              count: str = "count") -> DataFrame:
    """Per ``keys`` the sum of doubles without a scale and the number of rows;
    the same bits for any order and partitioning.

    A value is v = (hi + lo / 2**54) * 2**(32 k) with integers hi and lo, which
    loses nothing; they are added as decimals for each k (up to 10**11 rows of a
    group). The few sums of a group are carried into digits of base 2**32, from
    -2**31 to 2**31, and read from the highest down. Nulls are left out of the
    sum (null where no value is left) but counted as rows; a NaN or infinities of
    both signs give NaN, infinities of one sign that one.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    plain = v.isNotNull() & ~F.isnan(v) & (size < float("inf"))
    k = F.when(plain & (size > 0), F.floor(F.floor(F.log2(size)) / 32)).otherwise(0).cast("int")
    # two steps, as 2 ** 1024 is no double; both only move the exponent
    near = v * F.pow(F.lit(2.0), -16 * F.col("_k")) * F.pow(F.lit(2.0), -16 * F.col("_k"))
    limbs = (df.select(*keys, v.alias(value), k.alias("_k")).withColumn("_hi", F.when(plain, near).cast("long"))
             .withColumn("_lo", F.when(plain, ((near - F.col("_hi")) * 2.0 ** 54)).cast("long")))
    whole = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    each = limbs.groupBy(*keys, "_k").agg(
        whole("_hi").alias("hi"), whole("_lo").alias("lo"), F.count(value).alias("values"), F.count(F.lit(1)).alias("rows"),
        F.max(F.isnan(v)).alias("nan"), F.max(v == float("inf")).alias("up"), F.max(v == float("-inf")).alias("down"))
    each = each.withColumn("t", F.expr("cast(hi * 18014398509481984 + lo as decimal(38,0))"))  # units of 2 ** (32 k - 54)
    out = each.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "t"))).alias("parts"), F.min("_k").alias("low"), F.max("_k").alias("high"),
        F.sum("values").alias("values"), F.sum("rows").alias(count),
        *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("nan", "up", "down")])
    digits = F.expr("""aggregate(sequence(low, high + 4),
        named_struct('c', cast(0 as decimal(38,0)), 'out', cast(array() as array<double>)),
        (s, k) -> transform(array(cast(s.c + coalesce(parts[k], 0) as decimal(38,0))), t -> named_struct(
            'c', cast(round(t / 4294967296) as decimal(38,0)),
            'out', concat(s.out, array(cast(t - cast(round(t / 4294967296) as decimal(38,0)) * 4294967296 as double)
                / 18014398509481984D * pow(2D, 16 * k) * pow(2D, 16 * k)))))[0],
        s -> reverse(s.out))""")
    added = F.aggregate(digits, F.lit(0.0), lambda a, x: a + x)
    nan = F.col("nan") | (F.col("up") & F.col("down"))
    return out.select(*keys, F.when(F.col("values") == 0, F.lit(None)).when(nan, float("nan"))
                      .when(F.col("up"), float("inf")).when(F.col("down"), float("-inf"))
                      .otherwise(added).cast("double").alias(total), count)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, null when the denominator is zero."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def percent_text(ratio: Column | str, digits: int = 2) -> Column:
    """Render a ratio as ``"12.34%"`` (the report lines of the ratio job);
    null for a null ratio."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(r.isNotNull(), F.format_string(f"%.{digits}f%%", r * F.lit(100.0)))
