"""The streamed flow: raw packets to merged packets to windows, with a counter row per batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtap.streaming.merge import TICK, MergeStream
from railtap.streaming.state import Versions
from railtap.streaming.windows import WindowStream


@dataclass
class FlowStream:
    """Feeds what a merge closes in a batch to a window stream.

    Merged packets are numbered by their group, without gaps, so the windows
    need no order of their own.  How many rows pass each stage is observed while
    they are written and goes to ``<root>/progress``, a row per batch; a replayed
    batch overwrites its row.
    """
    spark: SparkSession
    root: str
    merge: MergeStream
    windows: WindowStream

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t = Versions(self.spark, self.root)
        raw = batch.where(F.col(TICK).isNull()) if TICK in batch.columns else batch
        _, came = t.write_counted(raw.select(self.merge.capture), "arrived", batch_id)
        self._on(came, self.merge(batch, batch_id), batch_id)
        t.forget("arrived", batch_id - 1)

    def _on(self, came: int, merged: int, batch_id: int) -> None:
        t = Versions(self.spark, self.root)
        rows = self.merge.tables.read("merged", batch_id).where("chunk = 0").withColumn("_place", F.col("merge_event_id") - 1)
        made = self.windows(rows, batch_id)
        row = self.spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in (
            ("raw_packets", came), ("merged_packets", merged), ("windows", made))])
        t.write(row, "progress", batch_id)

    def finish(self, last_batch: int) -> None:
        """Close the groups still open after the stream has ended, and the windows they complete."""
        self._on(0, self.merge.finish(last_batch), last_batch + 1)

    def progress(self) -> DataFrame:
        """batch_id and the three counters, for all batches however long the stream runs."""
        return self.spark.read.parquet(f"{self.root}/progress")
