"""Split-packet merge across micro-batches.

Each micro-batch runs the batch operators over its own rows and one row per
capture that stands for the group left open before it, so a batch and a stream
give the same groups and a busy capture is handled block-wise as in a batch.
Rows of groups still open are appended as a part per batch and never written
again; the parts are read once, when their group closes.  One counter row per
capture says what is open and since which batch.

A group closes when a row with another key arrives, or by time alone: with
``idle_ms`` the stream carries ticks of a processing-time timer
(:func:`with_idle_ticks`), and a capture quiet for that long gives up its open
group.  Both clocks are the batch's logged time, so a replayed batch decides the
same, overwrites its own outputs and reads the same earlier versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railtap.operators.merge import merge_online, online_key
from railtap.operators.order import Track, islands
from railtap.schema import MERGE_PROTOCOLS
from railtap.streaming.state import Versions
from railtap.streaming.windows import number_arrivals

TICK = "_tick_ms"
AT = "_at_ms"


class _Quiet(StatefulProcessor):
    """One timer per key, moved on by every batch with rows; a key quiet until it fires gives a tick."""

    def __init__(self, idle_ms: int):
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(int(at[0] if isinstance(at, tuple) else at))
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"capture": [key[0]], TICK: [timerValues.getCurrentProcessingTimeInMs()]})

    def close(self) -> None:
        pass


def with_idle_ticks(stream: DataFrame, capture: str, idle_ms: int, shards: int = 16) -> DataFrame:
    """The stream's rows with the batch's time, and ticks of captures that were quiet for ``idle_ms``.

    Timers are kept per capture and shard of its rows, so a capture that delivers
    most of the rows is spread; only capture and shard reach the timers.
    """
    now = F.unix_millis(F.current_timestamp())
    shard = F.pmod(F.xxhash64(*stream.columns), F.lit(shards))
    kind = stream.schema[capture].dataType.simpleString()
    ticks = (stream.select(F.col(capture).alias("capture"), shard.alias("shard")).groupBy("capture", "shard")
             .transformWithStateInPandas(_Quiet(idle_ms), f"capture {kind}, {TICK} bigint", "Append", "ProcessingTime"))
    ticks = ticks.withColumnRenamed("capture", capture)
    rows = stream.withColumns({AT: now, TICK: F.lit(None).cast("bigint")})
    return rows.unionByName(ticks, allowMissingColumns=True)


@dataclass
class MergeStream:
    """A merge fed by ``foreachBatch``; closed groups go to ``<root>/merged/batch_id=N``.

    ``idle_ms`` needs a stream from :func:`with_idle_ticks`.  The envelope's
    time, where packets have one (``meta.packet_ts_ms``), is the time of the key.
    """
    spark: SparkSession
    root: str
    capture: str = "capture"
    order: tuple[str, ...] = ("ts_ms", "id_seq")
    protocols: tuple[str, ...] = MERGE_PROTOCOLS
    key: Callable[[DataFrame], Column] | None = None
    block_width: int = 1 << 12
    idle_ms: int | None = None

    def __post_init__(self) -> None:
        self.tables = Versions(self.spark, self.root)
        self.done = -1

    def _key(self, df: DataFrame) -> Column:
        if self.key:
            return self.key(df)
        return online_key(df, self.protocols, ts_ms="meta.packet_ts_ms" if "meta" in df.columns else None)

    def __call__(self, batch: DataFrame, batch_id: int) -> int:
        """Write the groups that this batch closes; returns how many merged packets they are."""
        ticks = None
        if TICK in batch.columns:
            ticks = batch.where(F.col(TICK).isNotNull()).groupBy(self.capture).agg(F.max(TICK).alias("tick"))
            batch = batch.where(F.col(TICK).isNull()).drop(TICK)
        return self._run(batch, ticks, batch_id)

    def _run(self, batch: DataFrame, ticks: DataFrame | None, batch_id: int, everything: bool = False) -> int:
        cap, t = self.capture, self.tables
        before = t.read("counters", batch_id - 1)
        at = F.col(AT) if AT in batch.columns else F.lit(None).cast("bigint")
        rows = number_arrivals(batch.withColumn("_at", at), cap, self.order, before, "_arrival").drop(AT)
        # written between the steps: each plan stays shallow, however much the stream does before
        rows = t.write(rows.withColumn("_mk", self._key(rows)), "numbered", batch_id)
        rows = t.write(self._grouped(rows, before), "grouped", batch_id)
        state = t.write(self._state(rows, before, ticks, batch_id, everything), "counters", batch_id)
        mine = rows.join(state.select(cap, "open_id"), cap).withColumn(
            "_open", F.coalesce(F.col("merge_event_id") == F.col("open_id"), F.lit(False))).drop("open_id", "_mk", "_at", "_first")
        t.write(mine.where("_open").drop("_open"), "open", batch_id)
        closed = mine.where(~F.col("_open")).drop("_open")
        parts = self._earlier_parts(state, before, batch_id)
        if parts is not None:
            closed = parts.unionByName(closed)
        _, made = t.write_counted(merge_online(closed, cap, "_arrival", self.protocols, written=True).drop("_arrival"), "merged", batch_id)
        self._forget(before, batch_id)
        self.done = batch_id
        return made

    def _grouped(self, rows: DataFrame, before: DataFrame | None) -> DataFrame:
        """The batch's rows with group number and place in the group, running on from the open groups."""
        cap = self.capture
        track = Track((cap,), ("_arrival",), F.floor(F.col("_arrival") / self.block_width))
        plain = rows.withColumn("_stands_in", F.lit(False))
        if before is not None:
            # the last row of an open group stands in for all of its rows
            carry = before.where(F.col("open_id").isNotNull()).select(
                cap, (F.col("seen") - 1).alias("_arrival"), F.col("open_key").alias("_mk"), F.lit(True).alias("_stands_in"))
            plain = plain.unionByName(carry.join(rows.select(cap).distinct(), cap, "left_semi"), allowMissingColumns=True)
        g = islands(plain, track, F.col("_mk"), group="_g", first="_first", ordinal="_pos", start=1)
        first = F.col("_arrival") - (F.col("_pos") - F.col("_first"))
        g = g.withColumn("_first", first).drop("_pos").where(~F.col("_stands_in")).drop("_stands_in")
        if before is None:
            g = g.withColumn("merge_event_id", F.col("_g"))
        else:
            g = g.join(before.select(cap, "groups", F.col("open_id").alias("_was"), "open_first"), cap, "left")
            g = g.withColumn("merge_event_id", F.col("_g") + F.coalesce("groups", F.lit(0)))
            g = g.withColumn("_first", F.when(F.col("merge_event_id") == F.col("_was"), F.col("open_first")).otherwise(F.col("_first")))
            g = g.drop("groups", "_was", "open_first")
        return g.withColumn("idx", F.col("_arrival") - F.col("_first")).drop("_g")

    def _state(self, rows: DataFrame, before: DataFrame | None, ticks: DataFrame | None, batch_id: int, everything: bool) -> DataFrame:
        """One row per capture: rows and closed groups so far, the open group's number, key, first row and first batch."""
        cap = self.capture
        now = rows.groupBy(cap).agg(
            F.max("merge_event_id").alias("_last"), F.max("_arrival").alias("_top"), F.max("_at").alias("_now"),
            F.max_by(F.struct("_mk", "_first"), F.col("_arrival")).alias("_end"))
        if before is None:
            s = now.withColumns({"seen": F.lit(0), "groups": F.lit(0), "at": F.lit(None).cast("bigint"), "open_id": F.lit(None).cast("bigint"),
                                 "open_first": F.lit(None).cast("bigint"), "since": F.lit(None).cast("int"),
                                 "open_key": F.col("_end._mk")})
        else:
            s = now.join(before, cap, "full_outer")
        s = s.join(ticks, cap, "left") if ticks is not None else s.withColumn("tick", F.lit(None).cast("bigint"))
        came = F.col("_last").isNotNull()
        at = F.coalesce("_now", "at")
        quiet = F.lit(True) if everything else F.coalesce(F.col("tick") - at >= F.lit(self.idle_ms or 0), F.lit(False))
        grown = F.when(came, F.when(F.col("_end._mk").isNotNull(), F.col("_last"))).otherwise(F.col("open_id"))
        open_id = F.when(~quiet, grown)
        known = F.coalesce("groups", F.lit(0))
        last = F.when(came, F.col("_last")).otherwise(known + F.col("open_id").isNotNull().cast("int"))
        same = open_id.eqNullSafe(F.col("open_id"))
        return s.select(
            cap, F.when(came, F.col("_top") + 1).otherwise(F.col("seen")).cast("bigint").alias("seen"),
            (last - open_id.isNotNull().cast("int")).cast("bigint").alias("groups"), at.alias("at"), open_id.alias("open_id"),
            F.when(open_id.isNotNull(), F.when(came, F.col("_end._first")).otherwise(F.col("open_first"))).cast("bigint").alias("open_first"),
            F.when(open_id.isNotNull(), F.when(same, F.col("since")).otherwise(F.lit(batch_id))).cast("int").alias("since"),
            F.when(open_id.isNotNull(), F.when(came, F.col("_end._mk")).otherwise(F.col("open_key"))).alias("open_key"))

    def _earlier_parts(self, state: DataFrame, before: DataFrame | None, batch_id: int) -> DataFrame | None:
        """Rows from earlier batches of the groups that close now."""
        if before is None:
            return None
        cap = self.capture
        done = before.where(F.col("open_id").isNotNull()).join(
            state.select(cap, F.col("open_id").alias("_still")), cap).where(~F.col("open_id").eqNullSafe(F.col("_still")))
        done = done.select(cap, F.col("open_id").alias("merge_event_id"), "since")
        first = done.agg(F.min("since")).first()[0]
        if first is None:
            return None
        parts = self.spark.read.parquet(*[self.tables.path("open", b) for b in range(first, batch_id)])
        return parts.join(done.drop("since"), [cap, "merge_event_id"], "left_semi")

    def _forget(self, before: DataFrame | None, batch_id: int) -> None:
        """Drop what neither the next batch nor a replay of this one can ask for."""
        for kind in ("numbered", "grouped", "counters"):
            self.tables.forget(kind, batch_id - 1)
        if before is not None:
            needed = before.agg(F.min("since")).first()[0]
            self.tables.forget("open", batch_id - 1 if needed is None else min(needed, batch_id - 1))

    def finish(self, last_batch: int) -> int:
        """Close the groups still open after the stream has ended."""
        none = self.tables.read("grouped", last_batch).drop("_arrival", "_mk", "_at", "_first", "merge_event_id", "idx").limit(0)
        return self._run(none, None, last_batch + 1, everything=True)

    def standing(self) -> tuple[int, int]:
        """Rows taken in and groups still open after the last finished batch."""
        if self.done < 0:
            return 0, 0
        r = self.tables.read("counters", self.done).agg(F.sum("seen"), F.count("open_id")).first()
        return r[0] or 0, r[1]

    def merged(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/merged").drop("batch_id")
