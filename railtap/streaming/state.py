"""What a job passes from one micro-batch to the next: small tables, a version per batch id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Versions:
    """Tables ``<root>/<kind>/batch_id=N``; a replayed batch overwrites its own and reads the same earlier ones."""
    spark: SparkSession
    root: str
    kept_from: dict[str, int] = field(default_factory=dict)

    def path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch}"

    def read(self, kind: str, batch: int) -> DataFrame | None:
        return self.spark.read.parquet(self.path(kind, batch)) if batch >= 0 else None

    def write(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(kind, batch))
        return self.read(kind, batch)

    def write_counted(self, df: DataFrame, kind: str, batch: int) -> tuple[DataFrame, int]:
        """The same, with the number of rows observed on their way out."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), kind, batch)
        return out, seen.get["rows"]

    def forget(self, kind: str, before: int) -> None:
        """Remove the versions of batches before ``before``, which no replay can ask for."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for batch in range(self.kept_from.get(kind, max(0, before - 16)), before):
            at = hadoop.Path(self.path(kind, batch))
            at.getFileSystem(conf).delete(at, True)
        self.kept_from[kind] = max(before, self.kept_from.get(kind, 0))
