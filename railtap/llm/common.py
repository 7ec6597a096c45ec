"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railtap.session import checkpoint

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rounds of :func:`swap_or_not`.
ROUNDS = 24


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python tasks a few MB at a time, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; row ids made before stay as they are."""
    return checkpoint(df.sparkSession, df, name)


def bounded_sample(df: DataFrame, key: str, size: int, rows: int) -> DataFrame:
    """The ``size`` rows with the smallest hashed keys, for fitting a model; ``rows`` is how many ``df`` has at most.

    Rows are thinned by their hash first, so that what the tasks hand on to the
    sort is about twice the sample and does not grow with their number.
    """
    h = F.xxhash64(F.col(key), F.lit(17))
    span = 1 << 40
    part = min(span, span * 2 * size // max(1, rows) + 1)
    return df.filter(F.pmod(h, F.lit(span)) < part).orderBy(F.pmod(h, F.lit(span)), key).limit(size)


def block_number(rows: int, least: int = 256) -> int:
    """Blocks for :func:`running_total`: as many as each block has rows, so both levels stay small."""
    return max(least, math.isqrt(max(0, rows)) + 1)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, blocks: int,
                  spread: list[str] | None = None) -> DataFrame:
    """Add the sum of ``value`` over the rows before each one within ``keys`` (not null, ``order`` unique).

    A key may hold any share of the rows: sums run inside hashed blocks of a
    key, the block totals are summed over one row per block, and both meet on
    the partitioning that the rows already have.  ``spread`` names the columns
    that choose the block (those of ``order`` unless given).
    """
    at = df.withColumn("_block", F.pmod(F.xxhash64(*(spread or order)), F.lit(blocks))).withColumn("_value", value)
    by = [*keys, "_block"]
    inside = at.withColumn("_inside", F.coalesce(
        F.sum("_value").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = at.groupBy(*by).agg(F.sum("_value").alias("_total"))
    base = totals.withColumn("_base", F.coalesce(
        F.sum("_total").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_total")
    return (inside.join(base, by).withColumn(out, F.col("_base") + F.col("_inside"))
            .drop("_block", "_value", "_inside", "_base"))


def swap_or_not(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Keyed pseudorandom permutation of 0..n-1 for any n (swap-or-not shuffle), as a Column.

    Each round pairs x with (k - x) mod n and swaps the two on a hashed bit, so
    every round, and thus the whole, maps the range onto itself.
    """
    def step(acc: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(*key, r), n)
        other = F.pmod(k - acc, n)
        swap = F.xxhash64(*key, r, F.lit(1), F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra ones of any name do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return need(df, *columns) if columns else df
