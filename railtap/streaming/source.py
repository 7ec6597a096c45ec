"""Stream sources and triggers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from railtap.sources.jsonl import union_streams

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a folder's files, oldest first."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def read_protocols(spark: SparkSession, root: str, protocols: list[str], schema: T.StructType | str, ident: str = "id",
                   fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """One stream from a folder per protocol, rows carrying their oldest-first order key ``(ts_ms, id_seq)``."""
    parts = [read_folder(spark, f"{root}/{p}", schema, fmt, files_per_trigger)
             .withColumn("protocol", F.coalesce("protocol", F.lit(p))) for p in protocols]
    return union_streams(parts, ident)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """RocksDB state store and, optionally, the number of state partitions for streams started inside."""
    want = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB}
    if partitions:
        want["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(writer: DataStreamWriter, checkpoint: str, drain: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Start a stream that drains what is there and stops, or one that keeps running."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if drain else {"processingTime": interval}
    return writer.trigger(**trigger).start()
