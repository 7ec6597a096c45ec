"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: UTC clock, the last of equal map keys, run-time re-planning with skew splitting."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may go without the setting; it gets a
    folder of its own once.  A cluster session without it is an error rather
    than a silent write to one machine's disk.
    """
    path = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT} to a folder every executor can reach")
    cached = os.environ.get("RAILTAP_LOCAL_DIR")
    if not cached:
        cached = os.environ["RAILTAP_LOCAL_DIR"] = tempfile.mkdtemp(prefix="railtap-")
    return cached


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(spark: SparkSession, df, name: str = "cut"):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss.

    The shuffle files of the write go with its end: nothing asks for them again.
    """
    path = fresh_path(spark, name)
    if (paths := _on_the_way.get()) is not None:
        paths.append(path)
    was = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if was is None else spark.conf.set(_SHUFFLE_CLEANUP, was)
    return spark.read.parquet(path)


def condensed(spark: SparkSession, build: Callable[[], DataFrame], name: str = "cut") -> DataFrame:
    """What ``build`` returns, written; the tables checkpointed on the way to it are removed.

    Nothing but its result may read what ``build`` checkpoints.
    """
    outer, paths = _on_the_way.get(), []
    token = _on_the_way.set(paths)
    try:
        out = checkpoint(spark, build(), name)
        kept = paths.pop()
        if outer is not None:
            outer.append(kept)
    finally:
        _on_the_way.reset(token)
        for path in paths:
            remove(spark, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own below :func:`shared_dir`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def block_count(spark: SparkSession) -> int:
    """How many range blocks to cut a global order into: one per shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
