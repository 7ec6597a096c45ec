"""Streaming queries; the SQL twins are the batch statements over the same rows."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from railtap.operators import score as SC
from railtap.operators import verdict as V
from railtap.session import fresh_path
from railtap.sources import sinks as K
from railtap.streaming import flow as SF
from railtap.streaming import merge as SM
from railtap.streaming import sinks as SK
from railtap.streaming import source as SS
from railtap.streaming import windows as SW
from suite.base import packets, query, r6, sql_r6
from suite.sequences import _HOUR, _RUNS, _sql_merge, _sql_windows

_SHARDS = 3


def _deliver(spark, df, path, writer, by="seq"):
    """Deliver rows in a few parts of many files, oldest first, and drain the stream after each.

    ``writer`` turns the stream into its writer; every part is a micro-batch.
    The last query is returned.
    """
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    width = (hi - lo) // _SHARDS + 1
    part, progress, query_ = F.floor((F.col(by) - lo) / width), fresh_path(spark, "progress"), None
    for s in range(_SHARDS):
        df.where(part == s).repartition(F.col(by)).write.mode("append").parquet(path)
        query_ = SS.start(writer(SS.read_folder(spark, path, df.schema)), progress)
        query_.awaitTermination()
    return query_


@query("stream_windows", _sql_windows(80, 5, "n = 80", f"CAST(sum(k) AS BIGINT) AS k_sum, {sql_r6('avg(value)')} AS value_avg, last(sip ORDER BY i) AS last_sip").replace(
    "SELECT * FROM a", "SELECT capture, window_id, start, \"end\", k_sum, value_avg, last_sip FROM a"))
def stream_windows(spark, sf):
    """Sliding windows over a stream that arrives in several micro-batches and is numbered as it arrives."""
    p = packets(spark, sf, "seq", "capture", "value", "sip", "k")
    job = SW.WindowStream(spark, fresh_path(spark, "windows"), 80, 5, {
        "k_sum": ("sum", F.col("k")), "value_avg": ("avg", F.col("value")), "last_sip": ("last", F.col("sip"))},
        ("k", "value", "sip"), order=("seq",))
    _deliver(spark, p, fresh_path(spark, "stream"), lambda stream: stream.writeStream.foreachBatch(job))
    return job.windows().select("capture", "window_id", "start", "end", "k_sum", r6("value_avg").alias("value_avg"), "last_sip")


@query("stream_merge", f"""WITH {_RUNS} SELECT capture, merge_event_id, count(*) AS raw_count, min(seq) AS seq, first(sip ORDER BY seq) AS sip,
 {_sql_merge('modbus_fc', 'modbus', False)}, {_sql_merge('xgt_fen_data', 'xgt_fen', False)} FROM runs GROUP BY capture, merge_event_id""")
def stream_merge(spark, sf):
    """Split packets merged across micro-batches; a group may span deliveries."""
    job = SM.MergeStream(spark, fresh_path(spark, "merge"))
    q = _deliver(spark, _hourly(spark, sf), fresh_path(spark, "stream"), lambda stream: stream.writeStream.foreachBatch(job))
    job.finish(q.lastProgress["batchId"])
    return job.merged().select("capture", "merge_event_id", "raw_count", "seq", "sip", "modbus_fc", "xgt_fen_data")


_HALF = "CAST((seq - (SELECT min(event_id) FROM events)) // ((SELECT max(event_id) - min(event_id) FROM events) // 2 + 1) AS VARCHAR)"


@query("stream_idle_flush", f"""WITH {_RUNS.replace(_HOUR, f"{_HOUR} || '@' || {_HALF}")} SELECT capture, merge_event_id, count(*) AS raw_count, min(seq) AS seq,
 {_sql_merge('modbus_fc', 'modbus', False)} FROM runs GROUP BY capture, merge_event_id""")
def stream_idle_flush(spark, sf):
    """Open groups closed by time alone: two deliveries with a pause that splits the groups reaching over it."""
    p = _hourly(spark, sf)
    src, progress, idle = fresh_path(spark, "stream"), fresh_path(spark, "progress"), 1000
    job = SM.MergeStream(spark, fresh_path(spark, "merge"), idle_ms=idle)
    lo, hi = p.agg(F.min("seq"), F.max("seq")).first()
    part, rows = F.floor((F.col("seq") - lo) / ((hi - lo) // 2 + 1)), 0
    with SS.state_settings(spark):
        for s in range(2):
            mine = p.where(part == s)
            mine.repartition(F.col("seq")).write.mode("append").parquet(src)
            rows += mine.count()
            stream = SM.with_idle_ticks(SS.read_folder(spark, src, p.schema), "capture", idle)
            q = SS.start(stream.writeStream.foreachBatch(job), progress, drain=False, interval="500 milliseconds")
            while job.standing() != (rows, 0) and q.isActive:
                time.sleep(0.2)
            q.stop()   # a batch cut off here is run again from the same input
            if q.exception():
                raise q.exception()
    return job.merged().select("capture", "merge_event_id", "raw_count", "seq", "modbus_fc")


def _hourly(spark, sf):
    """Packets with a merge key of protocol and hour."""
    p = packets(spark, sf, "seq", "capture", "protocol", "timestamp", "sip", "ts_us", "k", "modbus_fc", "xgt_fen_data")
    return p.withColumns({"timestamp": F.substring("timestamp", 1, 13), "sq": F.lit("run"), "ts_ms": F.floor(F.col("ts_us") / 1000),
                          "id_seq": F.col("seq")}).drop("k", "ts_us")


@query("stream_multi_sink", f"""WITH p AS (SELECT event_id AS seq, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, value / 30.0 AS mse FROM events),
f AS (SELECT 'final' AS sink, seq + 1 AS seq_id, seq AS window_id, CASE WHEN k % 2 = 0 THEN 'scan' ELSE 'UNKNOWN' END AS pattern, {sql_r6('mse')} AS score FROM p),
a AS (SELECT seq, mse, k, row_number() OVER (ORDER BY seq) + (SELECT count(*) FROM p WHERE k = 7) AS seq_id FROM p WHERE {sql_r6('mse')} >= 1.0)
SELECT * FROM f UNION ALL SELECT 'alerts', seq_id, seq, CASE WHEN k % 2 = 0 THEN 'scan' ELSE 'UNKNOWN' END, {sql_r6('mse')} FROM a
UNION ALL SELECT 'alarms', seq_id, NULL, CASE WHEN k % 2 = 0 THEN 'scan' ELSE 'UNKNOWN' END, NULL FROM a""")
def stream_multi_sink(spark, sf):
    """Every result, the alerts with ids running on from earlier ones, and the alarms, per micro-batch."""
    p = packets(spark, sf, "seq", "protocol", "timestamp", "sip", "dip", "src_asset", "dst_asset", "value", "k")
    src, root = fresh_path(spark, "stream"), fresh_path(spark, "sinks")
    null = F.lit(None).cast("double")
    earlier = fresh_path(spark, "alerts")   # alerts that an earlier run stored
    K.append_jsonl(p.where("k = 7").select("seq"), earlier)
    sinks = SK.ResultSinks(spark, root, ("window_id",), stored=K.count_records(spark, earlier))
    _deliver(spark, p, src, lambda stream: _verdicts(stream, null).writeStream.foreachBatch(sinks))
    ddl = "seq_id bigint, window_id bigint, pattern string, summary struct<anomaly_score:double>"
    out = None
    for sink in ("final", "alerts", "alarms"):
        d = spark.read.schema(ddl).json(f"{root}/{sink}").select(
            F.lit(sink).alias("sink"), "seq_id", "window_id", "pattern", F.col("summary.anomaly_score").alias("score"))
        out = d if out is None else out.unionByName(d)
    return out


def _verdicts(s, null):
    v = s.select(F.col("seq").alias("window_id"), r6(F.col("value") / 30.0).alias("mse"), F.lit(1.0).alias("threshold"),
                 F.lit(0.1).alias("temporal_error_max"), F.when(F.col("k") % 2 == 0, "scan").alias("pattern"),
                 null.alias("pattern_prob"), null.alias("probs_entropy"), F.lit(None).cast("int").alias("num_classes"),
                 null.alias("similarity"), null.alias("latent_distance"),
                 F.struct("protocol", "timestamp", "sip", "dip", "src_asset", "dst_asset").alias("last"))
    v = v.withColumn("is_anomaly_pred", SC.anomaly_prediction(F.col("mse"), 1.0))
    return V.with_alert(V.normalise(V.assess(v))).select("window_id", "pattern", "summary", "alert")


@query("stream_protocol_union", """SELECT CASE event_type WHEN 'click' THEN 'modbus' ELSE 'xgt_fen' END AS protocol, epoch_us(ts) // 1000 AS ts_ms, event_id AS id_seq FROM events WHERE event_type IN ('click', 'view')""")
def stream_protocol_union(spark, sf):
    """One stream read from a folder per protocol."""
    p = packets(spark, sf, "seq", "protocol", "ts_us", "k")
    root, out = fresh_path(spark, "protocols"), fresh_path(spark, "union")
    ids = p.select("protocol", F.concat_ws("-", F.floor(F.col("ts_us") / 1000).cast("string"), F.col("seq").cast("string")).alias("id"))
    for name in ("modbus", "xgt_fen"):
        ids.where(F.col("protocol") == name).drop("protocol").write.json(f"{root}/{name}")
    s = SS.read_protocols(spark, root, ["modbus", "xgt_fen"], "id string, protocol string")
    SS.start(s.writeStream.format("parquet").option("path", out), fresh_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("protocol", "ts_ms", "id_seq")


@query("stream_counters", f"""WITH {_RUNS}, g AS (SELECT capture, count(DISTINCT merge_event_id) AS n FROM runs GROUP BY capture)
SELECT (SELECT count(*) FROM events) AS raw_packets, CAST(sum(n) AS BIGINT) AS merged_packets, CAST(sum(greatest(0, (n - 80) // 5 + 1)) AS BIGINT) AS windows,
 CAST({_SHARDS} AS BIGINT) AS batches FROM g""")
def stream_counters(spark, sf):
    """Packets in, merged packets and windows of a stream, counted where they pass, a row per batch."""
    root = fresh_path(spark, "flow")
    merge = SM.MergeStream(spark, f"{root}/merge")
    windows = SW.WindowStream(spark, f"{root}/windows", 80, 5, {"raw": ("sum", F.col("raw_count"))}, ("raw_count",), ordinal="_place")
    job = SF.FlowStream(spark, root, merge, windows)
    q = _deliver(spark, _hourly(spark, sf), fresh_path(spark, "stream"), lambda stream: stream.writeStream.foreachBatch(job))
    job.finish(q.lastProgress["batchId"])
    return job.progress().agg(*[F.sum(c).alias(c) for c in ("raw_packets", "merged_packets", "windows")],
                              F.count_if(F.col("raw_packets") > 0).alias("batches"))
