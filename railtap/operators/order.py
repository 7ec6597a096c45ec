"""Ordered work over captures of any size.

A capture (one source file or stream) may hold a large share of all rows, so
nothing here orders a whole capture in one task.  A :class:`Track` names the
capture columns, the order inside a capture and a *block*: an expression that
never decreases along the order.  Rows are sorted inside a block only; what
crosses a block edge (row counts, running sums, the last row seen) travels in a
table with one row per block, scanned per capture and joined back.  The window
and the join share the (capture, block) partitioning, so the rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.session import block_count, checkpoint

DEFAULT_BLOCK_ROWS = 1 << 18


@dataclass(frozen=True)
class Track:
    by: tuple[str, ...]
    order: tuple[str, ...]
    block: Column

    def keyed(self, *by: str) -> "Track":
        """The same order and blocks, partitioned by other columns."""
        return replace(self, by=tuple(by))


def track(by, order, block_rows: int = DEFAULT_BLOCK_ROWS) -> Track:
    """Track over a roughly dense leading order column (event id, line number): fixed-width blocks."""
    by = (by,) if isinstance(by, str) else tuple(by)
    order = (order,) if isinstance(order, str) else tuple(order)
    return Track(by, order, F.floor(F.col(order[0]) / F.lit(block_rows)))


def numeric_blocks(df: DataFrame, col: str, out: str, n: int | None = None) -> DataFrame:
    """Add ``out``: equal-weight range blocks of a numeric column, split at approximate quantiles.

    One mergeable sketch pass; only the split points reach the driver.  Rows
    with equal values share a block, so aggregate by value first when one value
    may repeat without bound.
    """
    n = n or block_count(df.sparkSession)
    qs = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(F.col(col).cast("double"), qs, 10 * n).alias("q")).first()["q"]
    splits = sorted({q for q in (got or []) if q == q and abs(q) != float("inf")})
    inf = float("inf")
    return Bucketizer(splits=[-inf, *splits, inf] if splits else [-inf, 0.0, inf], inputCol="_v",
                      outputCol=out, handleInvalid="keep").transform(
        df.withColumn("_v", F.col(col).cast("double"))).drop("_v")


def text_blocks(df: DataFrame, col: str, out: str, n: int | None = None) -> DataFrame:
    """Add ``out``: range blocks of a text column, as Spark's range partitioning cuts them.

    The result is written, since another run of the partitioning may cut elsewhere.
    """
    cut = df.repartitionByRange(n or block_count(df.sparkSession), col).withColumn(out, F.spark_partition_id())
    return checkpoint(df.sparkSession, cut, "text-blocks")


def _blocked(df: DataFrame, t: Track) -> DataFrame:
    return df.withColumn("_blk", t.block.cast("bigint"))


def _in_block(t: Track, *order: Column):
    return W.partitionBy(*t.by, "_blk").orderBy(*(order or t.order))


def _before(t: Track, *agg_order: Column):
    return (W.partitionBy(*t.by).orderBy(*(agg_order or ("_blk",)))
            .rowsBetween(W.unboundedPreceding, -1))


def _keys(t: Track) -> list[str]:
    return [*t.by, "_blk"]


def with_ordinal(df: DataFrame, t: Track, name: str, start: int = 0) -> DataFrame:
    """Dense position of every row in its capture, counted from ``start``."""
    b = _blocked(df, t)
    offs = b.groupBy(*_keys(t)).agg(F.count(F.lit(1)).alias("_n"))
    offs = offs.select(*_keys(t), F.coalesce(F.sum("_n").over(_before(t)), F.lit(0)).alias("_off"))
    out = b.join(offs, _keys(t))
    pos = F.col("_off") + F.row_number().over(_in_block(t)) - 1 + start
    return out.withColumn(name, pos.cast("bigint")).drop("_blk", "_off")


def hot_keys(df: DataFrame, keys, fraction: float = 0.01) -> list[int]:
    """Hashes of the key values that fill more than their share of a task, judged on a sample.

    The list is bounded by the share itself.  A missed or extra key only costs
    balance: callers give the same result for any list.
    """
    n = 4 * block_count(df.sparkSession)
    sample = df.select(F.xxhash64(*keys).alias("h")).sample(fraction, seed=11)
    counts = sample.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    top = counts.orderBy(F.col("c").desc()).limit(n).collect()
    least = top[-1]["c"] if len(top) == n else 0
    # n keys above 1/n of the rows cannot exist, so the total is only needed when some key stands out
    if not top or top[0]["c"] < 32 or top[0]["c"] <= 2 * least:
        return []
    total = counts.agg(F.sum("c")).first()[0]
    return [r["h"] for r in top if r["c"] >= max(32, total / n)]


def occurrence(df: DataFrame, t: Track, keys, name: str, fraction: float = 0.01) -> DataFrame:
    """How many-th row with these key values this is (from 1), in track order.

    Ordinary keys are numbered in one window each.  Keys that hold a large part
    of the rows are cut into the track's blocks and numbered block-wise, so no
    key is bound to one task.
    """
    hot = hot_keys(df, keys, fraction)
    if not hot:
        w = W.partitionBy(*keys).orderBy(*t.order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    is_hot = F.xxhash64(*keys).isin(hot)
    b = df.withColumn("_blk", F.when(is_hot, t.block.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    cut = [*keys, "_blk"]
    offs = b.where(is_hot).groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offs = offs.select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = b.join(offs, cut, "left")
    nth = F.coalesce("_off", F.lit(0)) + F.row_number().over(W.partitionBy(*cut).orderBy(*t.order))
    return out.withColumn(name, nth.cast("bigint")).drop("_blk", "_off")


def with_running_sum(df: DataFrame, t: Track, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums along each capture; ``<name>_total`` is the capture's total."""
    b = _blocked(df, t)
    for k, e in sums.items():
        b = b.withColumn(k, e)
    tot = b.groupBy(*_keys(t)).agg(*[F.sum(k).alias(f"_s_{k}") for k in sums])
    whole = W.partitionBy(*t.by)
    tot = tot.select(*_keys(t),
                     *[F.coalesce(F.sum(f"_s_{k}").over(_before(t)), F.lit(0)).alias(f"_o_{k}") for k in sums],
                     *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_total") for k in sums])
    out = b.join(tot, _keys(t))
    w = _in_block(t).rowsBetween(W.unboundedPreceding, 0)
    for k in sums:
        out = out.withColumn(k, F.col(f"_o_{k}") + F.sum(k).over(w))
    return out.drop("_blk", *[f"_o_{k}" for k in sums])


def with_neighbour(df: DataFrame, t: Track, value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Value of the previous (or next) row in the capture, across block edges; null at the ends."""
    b = _blocked(df, t).withColumn("_val", F.struct(value.alias("v")))
    at = F.struct(*t.order)
    edge = b.groupBy(*_keys(t)).agg((F.min_by if ahead else F.max_by)("_val", at).alias("_edge"))
    step = F.lead if ahead else F.lag
    edge = edge.select(*_keys(t), step("_edge").over(W.partitionBy(*t.by).orderBy("_blk")).alias("_edge"))
    out = b.join(edge, _keys(t))
    near = F.coalesce(step("_val").over(_in_block(t)), F.col("_edge"))
    return out.withColumn(name, near["v"]).drop("_blk", "_val", "_edge")


def islands(df: DataFrame, t: Track, key: Column, group: str = "group_id", first: str = "group_first",
            ordinal: str = "ordinal", start: int = 1, alone: str | None = None) -> DataFrame:
    """Number the runs of consecutive rows with equal keys; a null key stands alone and ends a run.

    Adds the row's ordinal in the capture, the dense run number and the ordinal
    of the run's first row; under the name ``alone`` also whether the row is all of its run.
    """
    b = _blocked(df, t).withColumn("_k", F.struct(key.alias("v")))
    at = F.struct(*t.order)
    edge = b.groupBy(*_keys(t)).agg(F.count(F.lit(1)).alias("_n"), F.max_by("_k", at).alias("_last"))
    edge = edge.select(*_keys(t), F.coalesce(F.sum("_n").over(_before(t)), F.lit(0)).alias("_off"),
                       F.lag("_last").over(W.partitionBy(*t.by).orderBy("_blk")).alias("_carry"))
    w = _in_block(t)
    rows = b.join(edge, _keys(t))
    rows = (rows.withColumn(ordinal, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
            .withColumn("_prev", F.coalesce(F.lag("_k").over(w), F.col("_carry"))))
    new = F.col("_prev").isNull() | F.col("_k.v").isNull() | ~(F.col("_prev.v").eqNullSafe(F.col("_k.v")))
    rows = rows.withColumn("_new", new.cast("int"))
    starts = F.when(F.col("_new") == 1, F.col(ordinal))
    heads = [F.min_by("_new", F.struct(at, "_new")).alias("_head")] if alone else []
    carry = rows.groupBy(*_keys(t)).agg(F.sum("_new").alias("_g"), F.max(starts).alias("_st"), *heads)
    heads = [F.lead("_head").over(W.partitionBy(*t.by).orderBy("_blk")).alias("_next")] if alone else []
    carry = carry.select(*_keys(t), F.coalesce(F.sum("_g").over(_before(t)), F.lit(0)).alias("_go"),
                         F.max("_st").over(_before(t)).alias("_so"), *heads)
    w0 = w.rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(carry, _keys(t))
    if alone:
        # the capture's last row has no next one to go on with its run
        ends = F.coalesce(F.lead("_new").over(w), F.col("_next"), F.lit(1)) == 1
        out = out.withColumn(alone, (F.col("_new") == 1) & ends).drop("_next")
    return (out.withColumn(group, (F.col("_go") + F.sum("_new").over(w0) - 1 + start).cast("bigint"))
            .withColumn(first, F.coalesce(F.max(starts).over(w0), F.col("_so")))
            .drop("_blk", "_k", "_off", "_carry", "_prev", "_new", "_go", "_so"))


def segments(df: DataFrame, t: Track, flag: Column, x: str) -> DataFrame:
    """Runs of consecutive flagged rows as (capture, start, end) in terms of column ``x``."""
    runs = islands(df, t, F.when(flag, F.lit(True)).otherwise(F.lit(False)))
    return (runs.where(flag).groupBy(*t.by, "group_id")
            .agg(F.min(x).alias("seg_start"), F.max(x).alias("seg_end"), F.count(F.lit(1)).alias("n"))
            .drop("group_id"))


def strided(df: DataFrame, t: Track, keep: Column, stride: int) -> DataFrame:
    """Every ``stride``-th of the kept rows of each capture, the first included."""
    kept = with_ordinal(df.where(keep), t, "_pos")
    return kept.where(F.col("_pos") % stride == 0).drop("_pos")


def moving_average(df: DataFrame, by, ordinal: str, value: str, k: int, name: str,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Centred mean over ``k`` rows (``k // 2`` before), the edge value repeated past either end.

    ``ordinal`` is the dense position in the capture.  Blocks borrow the few
    rows their frames reach into from the neighbouring block.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    if k <= 1:
        return df.withColumn(name, F.col(value).cast("double"))
    before, after = k // 2, k - 1 - k // 2
    rows = max(block_rows, k)
    i = F.col(ordinal)
    home = F.floor(i / rows)
    offset = i - home * rows
    homes = F.array_compact(F.array(home, F.when((offset < after) & (home > 0), home - 1),
                                    F.when(offset >= rows - before, home + 1)))
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(homes))
    w = W.partitionBy(*by, "_blk").orderBy(ordinal).rowsBetween(-before, after)
    lost_left = F.greatest(F.lit(before) - i, F.lit(0))
    lost_right = F.lit(k) - F.count(F.lit(1)).over(w) - lost_left
    total = (F.sum(value).over(w) + lost_left * F.first(value).over(w) + lost_right * F.last(value).over(w))
    return (spread.withColumn(name, total / F.lit(float(k))).where(F.col("_blk") == F.col("_home"))
            .drop("_blk", "_home"))


def track_for(df: DataFrame, by, order, blocks: int | None = None, least_rows: int = 1 << 12) -> Track:
    """Track over an integer order column, its block width taken from the column's own range.

    Reads one column once; aims at a few blocks per shuffle partition so that a
    capture holding most of the rows is still spread over all of them.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    order = (order,) if isinstance(order, str) else tuple(order)
    lo, hi = df.agg(F.min(order[0]), F.max(order[0])).first()
    n = blocks or 4 * block_count(df.sparkSession)
    width = max(least_rows, -(-((hi or 0) - (lo or 0) + 1) // n))
    return track(by, order, width)
