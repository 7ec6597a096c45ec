"""Several outputs per micro-batch: all results, alerts with their own ids, alarms, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtap.operators.order import Track, numeric_blocks, with_ordinal
from railtap.operators.verdict import alarm_payload
from railtap.sources.sinks import prune


@dataclass
class ResultSinks:
    """``foreachBatch`` writer; a batch owns the partition named by its id in every sink.

    Ids run on from the previous batch through a one-row counter table per
    batch, starting after ``stored`` alerts of earlier runs.
    """
    spark: SparkSession
    root: str
    order: tuple[str, ...]
    stored: int = 0
    engine: str = "dl"

    def _path(self, sink: str, batch: int) -> str:
        return f"{self.root}/{sink}/batch_id={batch}"

    def _counters(self, batch: int) -> tuple[int, int]:
        if batch <= 0:
            return 0, self.stored
        r = self.spark.read.parquet(self._path("counters", batch - 1)).first()
        return r["windows"], r["alerts"]

    def _numbered(self, df: DataFrame, name: str, start: int) -> DataFrame:
        rows = numeric_blocks(df.withColumn("_run", F.lit(0)), self.order[0], "_part")
        return with_ordinal(rows, Track(("_run",), self.order, F.col("_part")), name, start).drop("_run", "_part")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Expects verdict rows with ``summary``, ``pattern`` and ``alert``."""
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            windows, alerts = self._counters(batch_id)
            self._numbered(prune(rows), "seq_id", windows + 1).write.mode("overwrite").json(self._path("final", batch_id))
            hot = self._numbered(rows.where("alert"), "seq_id", alerts + 1)
            prune(hot).write.mode("overwrite").json(self._path("alerts", batch_id))
            prune(alarm_payload(hot, self.engine)).write.mode("overwrite").json(self._path("alarms", batch_id))
            n = rows.agg(F.count(F.lit(1)).alias("w"), F.count_if("alert").alias("a"))
            n.select((F.col("w") + windows).alias("windows"), (F.col("a") + alerts).alias("alerts")) \
             .coalesce(1).write.mode("overwrite").parquet(self._path("counters", batch_id))
        finally:
            rows.unpersist()
