"""Count windows across micro-batches.

Each micro-batch runs the batch windows over its rows and the rows that the next
window of each capture reaches back to.  Only that tail, fewer rows than a window
has, and one counter row per capture pass from batch to batch; panes, blocks and
frames are those of :func:`railtap.operators.windows.sliding`, so a busy capture
is spread over its blocks and no Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railtap.operators.order import Track, numeric_blocks, with_ordinal
from railtap.operators.windows import sliding
from railtap.streaming.state import Versions


def number_arrivals(batch: DataFrame, capture: str, order: tuple[str, ...], seen: DataFrame | None, name: str) -> DataFrame:
    """Number a batch's rows oldest first within their capture, after those of earlier batches.

    Rows of an earlier time that arrive later are simply appended; ``seen`` has
    the rows counted so far by capture.
    """
    rows = numeric_blocks(batch, order[0], "_part")
    rows = with_ordinal(rows, Track((capture,), order, F.col("_part")), name).drop("_part")
    if seen is None:
        return rows
    rows = rows.join(seen.select(capture, F.col("seen").alias("_seen")), capture, "left")
    return rows.withColumn(name, F.col(name) + F.coalesce("_seen", F.lit(0))).drop("_seen")


@dataclass
class WindowStream:
    """Full windows fed by ``foreachBatch``; they go to ``<root>/windows/batch_id=N``.

    ``aggs`` is as in ``sliding``, over ``columns`` of the rows.  ``ordinal`` names
    the rows' dense position in the capture where they have one; without it the
    stream numbers them in arrival order, oldest first within a batch.
    """
    spark: SparkSession
    root: str
    size: int
    step: int
    aggs: dict[str, tuple[str, Column]]
    columns: tuple[str, ...]
    capture: str = "capture"
    order: tuple[str, ...] = ("ts_ms", "id_seq")
    ordinal: str | None = None

    def __post_init__(self) -> None:
        self.tables = Versions(self.spark, self.root)

    def _next_start(self) -> Column:
        """The first window start that the rows seen so far do not fill."""
        full = F.floor((F.col("seen") - self.size) / self.step) + 1
        return F.when(F.col("seen") < self.size, F.lit(0)).otherwise(full * self.step).cast("bigint")

    def __call__(self, batch: DataFrame, batch_id: int) -> int:
        """Write the windows that this batch completes; returns how many."""
        cap, t = self.capture, self.tables
        before, tail = t.read("counters", batch_id - 1), t.read("tail", batch_id - 1)
        if self.ordinal:
            rows = batch.withColumn("_row", F.col(self.ordinal).cast("bigint"))
        else:
            rows = number_arrivals(batch, cap, self.order, before, "_row")
        rows = rows.select(cap, "_row", *self.columns)
        if tail is not None:
            rows = tail.unionByName(rows)
        rows = t.write(rows, "rows", batch_id)
        counters = rows.groupBy(cap).agg((F.max("_row") + 1).alias("seen"))
        if before is not None:  # a capture without rows, in the batch and in the tail, keeps its counter
            counters = counters.unionByName(before).groupBy(cap).agg(F.max("seen").alias("seen"))
        counters = t.write(counters, "counters", batch_id)
        _, made = t.write_counted(sliding(rows, cap, "_row", self.size, self.step, self.aggs), "windows", batch_id)
        left = rows.join(counters.select(cap, self._next_start().alias("_next")), cap).where(F.col("_row") >= F.col("_next"))
        t.write(left.drop("_next"), "tail", batch_id)
        for kind in ("rows", "counters", "tail"):
            t.forget(kind, batch_id - 1)
        return made

    def windows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/windows").drop("batch_id")
