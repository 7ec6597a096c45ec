"""Ordered queries: ordinals, runs, merging, sliding windows, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.operators import attack as A
from railtap.operators import evaluate as EV
from railtap.operators import features as X
from railtap.operators import merge as G
from railtap.operators import order as O
from railtap.operators import windows as WIN
from railtap.plans import serve as SV
from railtap.plans import verdicts as V
from suite.base import event_track, packets, pkt_sql, query, r6, round_doubles, sql_r6, table

# --- order -------------------------------------------------------------------


@query("ordinals", f"""WITH {pkt_sql('seq', 'capture', 'sq', 'k')}
SELECT seq, capture, row_number() OVER (PARTITION BY capture ORDER BY seq) AS line_no,
 row_number() OVER (PARTITION BY capture, sq ORDER BY seq) AS nth FROM pkt""")
def ordinals(spark, sf):
    """Line number in the capture and occurrence number of a key."""
    p = packets(spark, sf, "seq", "capture", "sq", "k")
    t = event_track(p)
    return O.occurrence(O.with_ordinal(p, t, "line_no", start=1), t, ["capture", "sq"], "nth") \
        .select("seq", "capture", "line_no", "nth")


@query("alert_ids", f"""WITH {pkt_sql('seq', 'k')} SELECT seq, row_number() OVER (ORDER BY seq) + (SELECT count(*) FROM nation) AS alert_seq_id
 FROM pkt WHERE k > 90""")
def alert_ids(spark, sf):
    """Alert ids that continue after the rows already stored."""
    stored = table(spark, sf, "nation").count()
    p = packets(spark, sf, "seq", "k").where("k > 90").withColumn("run", F.lit(0))
    return O.with_ordinal(p, event_track(p, "run"), "alert_seq_id", start=stored + 1).select("seq", "alert_seq_id")


@query("union_oldest_first", f"""WITH {pkt_sql('seq', 'protocol', 'ts_us', 'k')}
SELECT protocol, ts_us // 1000 AS ts_ms, seq, row_number() OVER (ORDER BY ts_us // 1000, seq) - 1 AS pos FROM pkt""")
def union_oldest_first(spark, sf):
    """Several per-protocol streams read as one, oldest id first."""
    from railtap.sources.jsonl import union_streams
    p = packets(spark, sf, "seq", "protocol", "ts_us", "k")
    ids = p.select("protocol", F.concat_ws("-", F.floor(F.col("ts_us") / 1000).cast("string"),
                                           F.col("seq").cast("string")).alias("id"))
    u = union_streams([ids.where(F.col("protocol") == x) for x in ("modbus", "xgt_fen", "s7comm", "dns", "arp")], "id")
    u = O.numeric_blocks(u.withColumn("all", F.lit(0)), "ts_ms", "part")
    t = O.Track(("all",), ("ts_ms", "id_seq"), F.col("part"))
    return O.with_ordinal(u, t, "pos").select("protocol", "ts_ms", F.col("id_seq").alias("seq"), "pos")


@query("centered_moving_average", f"""WITH {pkt_sql('seq', 'capture', 'value')},
o AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM pkt),
e AS (SELECT o.capture, o.i, o.n, o.value,
  first_value(value) OVER (PARTITION BY capture ORDER BY i) AS f, last_value(value) OVER (PARTITION BY capture ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
  sum(value) OVER (PARTITION BY capture ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS s31,
  sum(value) OVER (PARTITION BY capture ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS s6 FROM o)
SELECT capture, CAST(i AS BIGINT) AS i, {sql_r6('(s31 + greatest(15 - i, 0) * f + greatest(i + 15 - (n - 1), 0) * l) / 31.0')} AS ma31,
 {sql_r6('(s6 + greatest(3 - i, 0) * f + greatest(i + 2 - (n - 1), 0) * l) / 6.0')} AS ma6 FROM e""")
def centered_moving_average(spark, sf):
    """Smoothed value per capture for an odd and an even width."""
    p = packets(spark, sf, "seq", "capture", "value")
    p = O.with_ordinal(p, event_track(p), "i")
    p = O.moving_average(p, "capture", "i", "value", 31, "ma31", block_rows=4096)
    p = O.moving_average(p, "capture", "i", "value", 6, "ma6", block_rows=4096)
    return p.select("capture", "i", r6("ma31").alias("ma31"), r6("ma6").alias("ma6"))


@query("attack_segments", f"""WITH {pkt_sql('seq', 'capture', 'k')},
f AS (SELECT *, k % 3 = 0 AS hit, row_number() OVER (PARTITION BY capture ORDER BY seq) AS rn FROM pkt),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY capture, hit ORDER BY seq) AS grp FROM f)
SELECT capture, min(seq) AS seg_start, max(seq) AS seg_end, count(*) AS n FROM g WHERE hit GROUP BY capture, grp""")
def attack_segments(spark, sf):
    """Stretches of consecutive attack rows."""
    p = packets(spark, sf, "seq", "capture", "k")
    return O.segments(p, event_track(p), F.col("k") % 3 == 0, "seq")


@query("exceed_points", f"""WITH {pkt_sql('seq', 'capture', 'value')},
x AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS rn FROM pkt WHERE value > 20)
SELECT capture, seq, value FROM x WHERE rn % 3 = 0""")
def exceed_points(spark, sf):
    """Every third point above the threshold."""
    p = packets(spark, sf, "seq", "capture", "value")
    return O.strided(p, event_track(p), F.col("value") > 20, 3).select("capture", "seq", "value")


# --- merging -----------------------------------------------------------------

# The merge key is coarsened to the hour so that runs longer than one packet occur.
_HOUR = "substr(\"timestamp\", 1, 13)"
_RUNS = f"""{pkt_sql('seq', 'capture', 'protocol', 'timestamp', 'sip', 'len', 'ts_us', 'k', 'modbus_fc', 'modbus_regs_val', 'modbus_regs_translated_addr',
 'xgt_fen_cmd', 'xgt_fen_data', 'xgt_fen_word_value', 'xgt_fen_word_offset')},
keyed AS (SELECT *, CASE WHEN protocol IN ('modbus', 'xgt_fen') THEN protocol || '@' || {_HOUR} END AS key FROM pkt),
prev AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS ordinal,
 lag(key) OVER (PARTITION BY capture ORDER BY seq) AS pk FROM keyed),
flag AS (SELECT *, CASE WHEN key IS NULL OR pk IS NULL OR key <> pk THEN 1 ELSE 0 END AS new FROM prev),
grp AS (SELECT *, CAST(sum(new) OVER (PARTITION BY capture ORDER BY seq) AS BIGINT) AS merge_event_id FROM flag),
runs AS (SELECT *, row_number() OVER (PARTITION BY capture, merge_event_id ORDER BY seq) - 1 AS idx FROM grp)"""


def _runs(spark, sf):
    p = packets(spark, sf, "seq", "capture", "protocol", "timestamp", "sip", "len", "ts_us", "k", "modbus_fc",
                "modbus_regs_val", "modbus_regs_translated_addr", "xgt_fen_cmd", "xgt_fen_data", "xgt_fen_word_value",
                "xgt_fen_word_offset")
    hour = p.withColumn("sq", F.lit("")).withColumn("timestamp", F.substring("timestamp", 1, 13))
    return G.groups(hour, event_track(hour), G.offline_key(hour))


@query("consecutive_groups", f"""WITH {_RUNS} SELECT capture, seq, ordinal, merge_event_id, idx FROM runs""")
def consecutive_groups(spark, sf):
    """Runs of packets that belong together."""
    return _runs(spark, sf).select("capture", "seq", "ordinal", "merge_event_id", "idx")


@query("merge_key_online", f"""WITH {pkt_sql('seq', 'protocol', 'timestamp', 'sq', 'modbus_tid', 'ts_us', 'k')}
SELECT seq, protocol IN ('modbus', 'xgt_fen') AS merged, CASE WHEN protocol IN ('modbus', 'xgt_fen') THEN
  CASE WHEN k % 2 = 0 THEN protocol || '|' || "timestamp" || '|' || sq
   WHEN k % 4 = 1 THEN protocol || '|' || "timestamp" || '|' || modbus_tid ELSE protocol || '|' || CAST(ts_us // 1000 // 3 AS VARCHAR) || '|bucket' END END AS key FROM pkt""")
def merge_key_online(spark, sf):
    """Serving merge key: id and timestamp when there is one, else the time bucket."""
    p = packets(spark, sf, "seq", "protocol", "timestamp", "sq", "modbus_tid", "ts_us", "k")
    odd = F.col("k") % 2 == 1
    p = p.withColumn("sq", F.when(~odd, F.col("sq"))) \
         .withColumn("modbus_tid", F.when(F.col("k") % 4 == 1, F.col("modbus_tid")))
    key = G.online_key(p)
    return p.select("seq", key.isNotNull().alias("merged"),
                    F.when(key.isNotNull(), F.concat_ws("|", key["p"], key["t"], key["q"])).alias("key"))


def _sql_merge(field: str, owner: str, keep_null: bool) -> str:
    agg = f"to_json(list({field} ORDER BY seq){'' if keep_null else f' FILTER ({field} IS NOT NULL)'})"
    same = f"min({field}) = max({field})" + (f" AND count({field}) = count(*)" if keep_null else "")
    return (f"CASE WHEN count(*) = 1 OR first(protocol ORDER BY seq) <> '{owner}' THEN first({field} ORDER BY seq) "
            f"WHEN count({field}) = 0 THEN NULL WHEN {same} THEN min({field}) ELSE CAST({agg} AS VARCHAR) END AS {field}")


def _sql_pair(field: str, owner: str) -> str:
    return (f"CASE WHEN count(*) = 1 OR first(protocol ORDER BY seq) <> '{owner}' THEN first({field} ORDER BY seq) "
            f"ELSE CAST(to_json(flatten(list(CAST(CAST({field} AS JSON) AS VARCHAR[]) ORDER BY seq))) AS VARCHAR) END AS {field}")


@query("merge_online", f"""WITH {_RUNS} SELECT capture, merge_event_id, count(*) AS raw_count, min(seq) AS seq, first(sip ORDER BY seq) AS sip,
 first(len ORDER BY seq) AS len, {_sql_merge('modbus_fc', 'modbus', False)}, {_sql_merge('modbus_regs_val', 'modbus', False)},
 {_sql_merge('xgt_fen_cmd', 'xgt_fen', False)}, {_sql_merge('xgt_fen_data', 'xgt_fen', False)} FROM runs GROUP BY capture, merge_event_id""")
def merge_online(spark, sf):
    """Merged packets of the serving path."""
    return G.merge_online(_runs(spark, sf), "capture", "seq").select(
        "capture", "merge_event_id", "raw_count", "seq", "sip", "len", "modbus_fc", "modbus_regs_val", "xgt_fen_cmd",
        "xgt_fen_data")


@query("merge_offline", f"""WITH {_RUNS} SELECT capture, merge_event_id, count(*) AS raw_count, min(seq) AS seq, {_sql_merge('modbus_fc', 'modbus', True)},
 {_sql_pair('modbus_regs_val', 'modbus')}, {_sql_pair('modbus_regs_translated_addr', 'modbus')}, {_sql_merge('xgt_fen_data', 'xgt_fen', True)},
 {_sql_pair('xgt_fen_word_value', 'xgt_fen')}, {_sql_pair('xgt_fen_word_offset', 'xgt_fen')} FROM runs GROUP BY capture, merge_event_id""")
def merge_offline(spark, sf):
    """Merged packets of the batch path."""
    return G.merge_offline(_runs(spark, sf), "capture", "seq").select(
        "capture", "merge_event_id", "raw_count", "seq", "modbus_fc", "modbus_regs_val", "modbus_regs_translated_addr",
        "xgt_fen_data", "xgt_fen_word_value", "xgt_fen_word_offset")


_LONG_CHUNK = 1024


@query("merge_long_run", f"""WITH {pkt_sql('seq', 'k', 'sip', 'modbus_fc', 'modbus_regs_val', 'value')}, n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx FROM pkt)
SELECT idx // {_LONG_CHUNK} AS chunk, (SELECT count(*) FROM n) AS raw_count, (SELECT min(seq) FROM n) AS seq, (SELECT arg_min(sip, seq) FROM n) AS sip,
 CAST(to_json(list(modbus_fc ORDER BY seq)) AS VARCHAR) AS modbus_fc, CAST(to_json(list(modbus_regs_val ORDER BY seq)) AS VARCHAR) AS modbus_regs_val
 FROM n GROUP BY idx // {_LONG_CHUNK}""")
def merge_long_run(spark, sf):
    """The whole table as one run: every value is in the chunk rows of its one group."""
    p = packets(spark, sf, "seq", "k", "sip", "modbus_fc", "modbus_regs_val").withColumns(
        {"capture": F.lit("all"), "protocol": F.lit("modbus"), "timestamp": F.lit("t"), "sq": F.lit("1")})
    g = G.groups(p, event_track(p), G.offline_key(p))
    return G.merge_online(g, "capture", "seq", chunk_rows=_LONG_CHUNK).select("chunk", "raw_count", "seq", "sip", "modbus_fc", "modbus_regs_val")


_LONG = f"""{pkt_sql('seq', 'k', 'modbus_translated_addr', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_data', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'value')},
two AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'modbus' ELSE 'xgt_fen' END AS capture FROM pkt),
key_list AS (SELECT capture, seq, CAST(CAST(CASE WHEN k % 2 = 0 THEN modbus_translated_addr ELSE xgt_fen_translated_addr END AS JSON) AS VARCHAR[]) AS l FROM two),
val_list AS (SELECT capture, seq, CAST(CAST(CASE WHEN k % 2 = 0 THEN modbus_regs_val ELSE xgt_fen_word_value END AS JSON) AS DOUBLE[]) AS l FROM two),
keys AS (SELECT capture, a, row_number() OVER (PARTITION BY capture ORDER BY seq, pos) AS place FROM (SELECT capture, seq, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM key_list)),
vals AS (SELECT capture, v, row_number() OVER (PARTITION BY capture ORDER BY seq, pos) AS place FROM (SELECT capture, seq, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM val_list)),
slots AS (SELECT capture, a, arg_min(v, place) AS v FROM keys JOIN vals USING (capture, place) GROUP BY capture, a),
slot_sums AS (SELECT capture, count(*) AS slots, sum(v) AS slot_sum FROM slots GROUP BY capture),
addr_sums AS (SELECT capture, count(*) AS n, min(CAST(a AS INT)) AS lo, max(CAST(a AS INT)) AS hi FROM keys WHERE capture = 'modbus' GROUP BY capture),
val_sums AS (SELECT capture, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS sd FROM vals WHERE capture = 'modbus' GROUP BY capture),
data_sums AS (SELECT capture, sum(length(xgt_fen_data) + 2) + count(xgt_fen_data) + 1 AS chars, sum(length(xgt_fen_data) - length(replace(xgt_fen_data, ' ', ''))) AS blanks
 FROM two WHERE capture = 'xgt_fen' GROUP BY capture)
SELECT capture, count(*) AS raw_count, CAST(any_value(a.n) AS DOUBLE) AS regs_count, CAST(any_value(a.lo) AS DOUBLE) AS addr_min, CAST(any_value(a.hi) AS DOUBLE) AS addr_max,
 CAST(any_value(a.hi - a.lo) AS DOUBLE) AS addr_range, any_value(v.lo) AS val_min, any_value(v.hi) AS val_max, {sql_r6('any_value(v.mean)')} AS val_mean, {sql_r6('any_value(v.sd)')} AS val_std,
 CAST(any_value(d.chars) AS DOUBLE) AS data_chars, CAST(any_value(d.blanks) AS DOUBLE) AS data_blanks, CAST(any_value(s.slots) AS INT) AS slots, any_value(s.slot_sum) AS slot_sum
FROM two LEFT JOIN addr_sums a USING (capture) LEFT JOIN val_sums v USING (capture) LEFT JOIN data_sums d USING (capture) LEFT JOIN slot_sums s USING (capture) GROUP BY capture"""


@query("merge_long_features", f"WITH {_LONG}")
def merge_long_features(spark, sf):
    """Two runs far longer than a chunk: each is one packet, its features those of the whole run."""
    p = packets(spark, sf, "seq", "k", "modbus_translated_addr", "modbus_regs_addr", "modbus_regs_val", "xgt_fen_data",
                "xgt_fen_translated_addr", "xgt_fen_word_value")
    p = p.withColumn("protocol", F.when(F.col("k") % 2 == 0, "modbus").otherwise("xgt_fen"))
    p = p.withColumns({"capture": F.col("protocol"), "timestamp": F.lit("t"), "sq": F.lit("1")})
    m = X.with_parsed(SV.merged_packets(p, event_track(p), "seq", chunk_rows=_LONG_CHUNK))
    raw = X.raw_values(m)
    names = {"regs_count": "modbus_regs_count", "addr_min": "modbus_regs_addr_min", "addr_max": "modbus_regs_addr_max",
             "addr_range": "modbus_regs_addr_range", "val_min": "modbus_regs_val_min", "val_max": "modbus_regs_val_max",
             "val_mean": "modbus_regs_val_mean", "val_std": "modbus_regs_val_std", "data_chars": "xgt_data_len_chars",
             "data_blanks": "xgt_data_num_spaces"}
    slots = F.coalesce(X.slot_map(m, "modbus"), X.slot_map(m, "xgt_fen"))
    total = F.aggregate(F.map_values(slots), F.lit(0.0), lambda a, v: a + v)
    return m.select("capture", "raw_count", *[(r6(raw[f]) if n in ("val_mean", "val_std") else raw[f]).alias(n) for n, f in names.items()],
                    F.size(slots).alias("slots"), total.alias("slot_sum"))


@query("consecutive_groups_online", f"""WITH {pkt_sql('seq', 'capture', 'protocol', 'sq', 'ts_us', 'k')},
keyed AS (SELECT *, CASE WHEN protocol IN ('modbus', 'xgt_fen') THEN CASE WHEN k % 2 = 0 THEN protocol || '|s|' || CAST(k % 3 AS VARCHAR)
  ELSE protocol || '|' || CAST(ts_us // 1000 // 600000 AS VARCHAR) || '|bucket' END END AS key FROM pkt),
prev AS (SELECT *, lag(key) OVER (PARTITION BY capture ORDER BY seq) AS pk FROM keyed),
flag AS (SELECT *, CASE WHEN key IS NULL OR pk IS NULL OR key <> pk THEN 1 ELSE 0 END AS new FROM prev)
SELECT capture, seq, CAST(sum(new) OVER (PARTITION BY capture ORDER BY seq) AS BIGINT) AS merge_event_id FROM flag""")
def consecutive_groups_online(spark, sf):
    """Runs by the serving key with the envelope's time: ids, time buckets and packets that never merge."""
    p = packets(spark, sf, "seq", "capture", "protocol", "sq", "ts_us", "k")
    p = p.withColumns({"timestamp": F.when(F.col("k") % 2 == 0, "s").otherwise(""), "sq": (F.col("k") % 3).cast("string"),
                       "ts_ms": F.floor(F.col("ts_us") / 1000)})
    g = G.groups(p, event_track(p), G.online_key(p, bucket_ms=600000, ts_ms="ts_ms"))
    return g.select("capture", "seq", "merge_event_id")


@query("merge_list_overflow", f"""WITH {_RUNS}, long AS (
 SELECT capture, merge_event_id, idx, 'modbus_fc' AS field, modbus_fc AS value FROM runs UNION ALL
 SELECT capture, merge_event_id, idx, 'xgt_fen_data', xgt_fen_data FROM runs) SELECT * FROM long WHERE idx >= 2""")
def merge_list_overflow(spark, sf):
    """What a merged list leaves to its long-form continuation."""
    g = _runs(spark, sf).select("capture", "merge_event_id", "idx", "modbus_fc", "xgt_fen_data")
    return G.list_overflow(g, "capture", list_rows=2)


@query("group_meta", f"""WITH {_RUNS} SELECT capture, merge_event_id, first(protocol ORDER BY seq) AS protocol,
 string_agg('id-' || seq, ',' ORDER BY seq) AS ids, 'id-' || min(seq) AS first_id, min(ts_us // 1000) AS ts_ms_min, max(ts_us // 1000) AS ts_ms_max,
 first("timestamp" ORDER BY seq)[:13] AS pop_time_first, last("timestamp" ORDER BY seq)[:13] AS pop_time_last, count(*) AS raw_count,
 min(seq) AS ingest_id_min, max(seq) AS ingest_id_max FROM runs GROUP BY capture, merge_event_id""")
def group_meta(spark, sf):
    """Ids, times and counts of every merged group."""
    g = _runs(spark, sf).withColumn("id", F.concat(F.lit("id-"), F.col("seq").cast("string"))) \
        .withColumn("ts_ms", F.floor(F.col("ts_us") / 1000))
    m = G.group_meta(g, "capture", "seq", "id", "ts_ms", "timestamp", "seq").drop("chunk")
    return m.withColumn("ids", F.array_join("ids", ","))


@query("merge_audit", f"""WITH {_RUNS}, after AS (SELECT capture, merge_event_id, count(*) AS raw_count FROM runs GROUP BY ALL)
SELECT 'before' AS side, capture, merge_event_id, idx, CAST(NULL AS BIGINT) AS raw_count FROM runs UNION ALL
SELECT 'after', capture, merge_event_id, 0, raw_count FROM after""")
def merge_audit(spark, sf):
    """Audit rows before and after the merge."""
    g = _runs(spark, sf)
    before = G.audit_before(g, "capture").withColumn("raw_count", F.lit(None).cast("bigint"))
    after = G.audit_after(G.merge_online(g.select("capture", "merge_event_id", "idx", "seq", "protocol"),
                                         "capture", "seq"), "capture").drop("merged_count")
    return before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))


@query("merge_totals", f"""WITH {_RUNS}, after AS (SELECT capture, merge_event_id, count(*) AS raw_count FROM runs GROUP BY ALL)
SELECT capture, CAST(sum(raw_count) AS BIGINT) AS packets_in, count(*) AS groups_out FROM after GROUP BY capture""")
def merge_totals(spark, sf):
    """Packets in and groups out per capture."""
    g = _runs(spark, sf).select("capture", "merge_event_id", "idx", "seq", "protocol")
    return G.merge_totals(G.merge_online(g, "capture", "seq"), "capture")


# --- windows -----------------------------------------------------------------

_ORD = f"""{pkt_sql('seq', 'capture', 'value', 'len', 'sip', 'k')},
o AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i FROM pkt)"""


def _sql_windows(size: int, step: int, keep: str, extra: str) -> str:
    """Windows by expanding every row to the windows that hold it, the way a small table affords."""
    return f"""WITH {_ORD},
w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - {size} + 1) / {float(step)})) AS BIGINT), i // {step} + 1)) AS window_id FROM o),
a AS (SELECT capture, window_id, window_id * {step} AS start, window_id * {step} + count(*) - 1 AS "end", count(*) AS n, {extra} FROM w GROUP BY capture, window_id)
SELECT * FROM a WHERE {keep}"""


_WIN_AGGS = (f"CAST(sum(k) AS BIGINT) AS k_sum, {sql_r6('avg(value)')} AS value_avg, max(value) AS value_max, min(k) AS k_min, "
             "bool_or(k = 58) AS hit, first(sip ORDER BY i) AS first_sip, last(sip ORDER BY i) AS last_sip")


def _ordinal(spark, sf):
    p = packets(spark, sf, "seq", "capture", "value", "len", "sip", "k")
    return O.with_ordinal(p, event_track(p), "i")


def _window_aggs():
    return {"k_sum": ("sum", F.col("k").cast("bigint")), "value_avg": ("avg", F.col("value")),
            "value_max": ("max", F.col("value")), "k_min": ("min", F.col("k")), "hit": ("any", F.col("k") == 58),
            "first_sip": ("first", F.col("sip")), "last_sip": ("last", F.col("sip"))}


@query("sliding_windows", _sql_windows(80, 5, "n = 80", _WIN_AGGS))
def sliding_windows(spark, sf):
    """Full windows of 80 packets every 5."""
    return round_doubles(WIN.sliding(_ordinal(spark, sf), "capture", "i", 80, 5, _window_aggs(), block_panes=256),
                         "value_max")


@query("sliding_windows_uneven", _sql_windows(20, 7, "n = 20", _WIN_AGGS))
def sliding_windows_uneven(spark, sf):
    """A step that does not divide the size."""
    return round_doubles(WIN.sliding(_ordinal(spark, sf), "capture", "i", 20, 7, _window_aggs(), block_panes=1024),
                         "value_max")


@query("tail_windows", _sql_windows(80, 30, "true", _WIN_AGGS))
def tail_windows(spark, sf):
    """Windows from every start, short ones at the end included."""
    return round_doubles(WIN.sliding(_ordinal(spark, sf), "capture", "i", 80, 30, _window_aggs(), tail="keep"),
                         "value_max")


@query("last_partial_window", _sql_windows(80, 30, "n = 80 OR start = 0 OR n >= 50", "CAST(sum(k) AS BIGINT) AS k_sum"))
def last_partial_window(spark, sf):
    """Full windows and the one partial window left in the buffer."""
    return WIN.sliding(_ordinal(spark, sf), "capture", "i", 80, 30, {"k_sum": ("sum", F.col("k").cast("bigint"))},
                       tail="keep_last")


@query("run_limits", _sql_windows(80, 5, "n = 80 AND window_id < 12", "CAST(sum(k) AS BIGINT) AS k_sum"))
def run_limits(spark, sf):
    """Only the first twelve windows of each capture."""
    return WIN.sliding(_ordinal(spark, sf), "capture", "i", 80, 5, {"k_sum": ("sum", F.col("k").cast("bigint"))},
                       max_windows=12)


@query("run_limits_total", f"""WITH {_RUNS}, w AS (SELECT capture, ordinal // 80 AS window_id, count(*) AS n FROM runs GROUP BY 1, 2 HAVING count(*) = 80)
SELECT 'raw' AS what, CAST(capture AS INT) AS capture, seq AS id FROM (SELECT * FROM runs ORDER BY seq LIMIT 500) UNION ALL
SELECT 'merged', capture, merge_event_id FROM (SELECT DISTINCT capture, merge_event_id FROM runs ORDER BY merge_event_id, capture LIMIT 300) UNION ALL
SELECT 'windows', capture, window_id FROM (SELECT * FROM w ORDER BY window_id, capture LIMIT 40)""")
def run_limits_total(spark, sf):
    """Limits of a whole run: raw packets, merged packets, windows."""
    g = _runs(spark, sf)
    merged = G.merge_online(g.select("capture", "merge_event_id", "idx", "seq", "protocol"), "capture", "seq").where("chunk = 0")
    windows = WIN.sliding(_ordinal(spark, sf), "capture", "i", 80, 80, {"full": ("count", F.lit(1))})
    parts = [("raw", g, "seq", 500, ("seq",)), ("merged", merged, "merge_event_id", 300, ("merge_event_id", "capture")),
             ("windows", windows, "window_id", 40, ("window_id", "capture"))]
    out = None
    for what, df, ident, n, order in parts:
        one = WIN.first_of_run(df, n, *order).select(F.lit(what).alias("what"), "capture", F.col(ident).cast("bigint").alias("id"))
        out = one if out is None else out.unionAll(one)
    return out


@query("window_arrays", _sql_windows(16, 4, "n = 16", "string_agg(CAST(k AS VARCHAR), ',' ORDER BY i) AS ks"))
def window_arrays(spark, sf):
    """Windows as ordered arrays, as a model takes them."""
    w = WIN.sliding(_ordinal(spark, sf), "capture", "i", 16, 4, {"ks": ("rows", F.col("k"))})
    return w.withColumn("ks", F.array_join(F.transform("ks", lambda x: x.cast("string")), ","))


@query("window_counts", f"""WITH {pkt_sql('capture')}, c AS (SELECT capture, count(*) AS n FROM pkt GROUP BY capture)
SELECT capture, n, CASE WHEN n < 80 THEN 0 ELSE 1 + (n - 80) // 5 END AS windows FROM c""")
def window_counts(spark, sf):
    """How many full windows a capture has."""
    p = packets(spark, sf, "capture").groupBy("capture").agg(F.count(F.lit(1)).alias("n"))
    return p.select("capture", "n", WIN.window_count(F.col("n"), 80, 5).alias("windows"))


_ATTACK = f"""{pkt_sql('seq', 'capture', 'protocol', 'modbus_fc', 'xgt_fen_cmd', 'k')},
o AS (SELECT *, (protocol = 'xgt_fen' AND CAST(xgt_fen_cmd AS BIGINT) IN (88, 89)) OR (protocol = 'modbus' AND CAST(modbus_fc AS BIGINT) = 6) AS flag,
 row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i FROM pkt)"""


@query("window_attack_labels", f"""WITH {_ATTACK},
w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 3) / 4.0)) AS BIGINT), i // 4 + 1)) AS window_id FROM o),
a AS (SELECT capture, window_id, window_id * 4 AS start, window_id * 4 + count(*) - 1 AS "end", count(*) AS n, CAST(bool_or(flag) AS INT) AS is_anomaly FROM w GROUP BY capture, window_id)
SELECT *, CASE WHEN is_anomaly = 1 THEN 'ATTACK' ELSE 'NORMAL' END AS pattern FROM a""")
def window_attack_labels(spark, sf):
    """A window holding any attack packet is an attack window."""
    p = packets(spark, sf, "seq", "capture", "protocol", "modbus_fc", "xgt_fen_cmd", "k")
    none = F.lit(None).cast("string")
    flag = A.attack_flag(F.lit("modbus_fc6"), F.col("protocol"), F.col("modbus_fc"), F.col("xgt_fen_cmd"), none, none)
    rows = O.with_ordinal(p.withColumn("flag", flag), event_track(p), "i")
    w = WIN.sliding(rows, "capture", "i", 4, 4, {"any": ("any", F.col("flag"))}, tail="keep")
    return w.select("capture", "window_id", "start", "end", "n", F.col("any").cast("int").alias("is_anomaly"),
                    F.when(F.col("any"), "ATTACK").otherwise("NORMAL").alias("pattern"))


# --- flagship ----------------------------------------------------------------

_VERDICT_CTE = f"""{pkt_sql('seq', 'capture', 'value', 'sip', 'dip', 'timestamp', 'k')},
o AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i FROM pkt),
w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 79) / 5.0)) AS BIGINT), i // 5 + 1)) AS window_id FROM o),
a AS (SELECT capture, window_id, window_id * 5 AS start, window_id * 5 + 79 AS "end", avg(value) AS raw_score, bool_or(k = 58) AS truth,
 last(sip ORDER BY i) AS src_ip, last(dip ORDER BY i) AS dst_ip, last("timestamp" ORDER BY i) AS detected_time FROM w GROUP BY capture, window_id HAVING count(*) = 80),
t AS (SELECT quantile_cont(raw_score, 0.99) AS thr FROM a WHERE NOT truth),
v AS (SELECT capture, window_id, start, "end", {sql_r6('raw_score')} AS score, CAST(truth AS INT) AS y_true, CAST(raw_score > thr AS INT) AS y_pred,
 src_ip, dst_ip, detected_time FROM a, t)"""


@query("window_verdicts", f"WITH {_VERDICT_CTE} SELECT * FROM v")
def window_verdicts(spark, sf):
    """Flagship: window the capture, score every window, fit the threshold on normal windows, judge."""
    p = packets(spark, sf, "seq", "capture", "value", "sip", "dip", "timestamp", "k")
    return round_doubles(V.score_windows(p, event_track(p), F.col("value"), F.col("k") == 58, 80, 5))


@query("flagship_metrics", f"""WITH {_VERDICT_CTE}, c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
 count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM v)
SELECT tp, tn, fp, fn, {sql_r6('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {sql_r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS precision,
 {sql_r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall FROM c""")
def flagship_metrics(spark, sf):
    """Confusion of the flagship verdicts."""
    p = packets(spark, sf, "seq", "capture", "value", "sip", "dip", "timestamp", "k")
    v = V.score_windows(p, event_track(p), F.col("value"), F.col("k") == 58, 80, 5)
    return round_doubles(EV.confusion(v).select("tp", "tn", "fp", "fn", "accuracy", "precision", "recall"))


# --- padding and compaction ----------------------------------------------------

@query("pad_by_index", """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), p AS (SELECT l_orderkey, unnest(range(0, 7)) AS pos FROM o),
c AS (SELECT l_orderkey, l_linenumber AS pos, last(l_quantity ORDER BY (l_partkey * 1000000 + l_suppkey) * 100 + l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT p.l_orderkey, CAST(p.pos AS INT) AS pos, coalesce(c.q, -1.0) AS cell FROM p LEFT JOIN c USING (l_orderkey, pos)""")
def pad_by_index(spark, sf):
    """Order lines spread over seven positions, gaps padded, later positions cut."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             ((F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")).alias("line"))
    return WIN.pad_positions(li, "l_orderkey", "line", "l_linenumber", 7, "l_quantity") \
        .select("l_orderkey", "pos", F.col("l_quantity").alias("cell"))


_CELLS = "[CASE WHEN l_quantity % 2 = 0 THEN -1.0 ELSE l_quantity END, CASE WHEN l_quantity % 3 = 0 THEN -2.0 ELSE l_discount END]"


@query("compact_sequence", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount, {_CELLS} AS c FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS t FROM s WHERE NOT (c[1] IN (-1.0, -2.0) AND c[2] IN (-1.0, -2.0))),
a AS (SELECT l_orderkey, count(*) FILTER (t <= 4) AS n, sum(CASE WHEN t <= 4 AND c[1] NOT IN (-1.0, -2.0) THEN c[1] * t ELSE 0 END) AS s1,
 sum(CASE WHEN t <= 4 AND c[2] NOT IN (-1.0, -2.0) THEN c[2] * t ELSE 0 END) AS s2 FROM k GROUP BY l_orderkey)
SELECT o.l_orderkey, CAST(greatest(coalesce(n, 0), 1) AS INT) AS length, {sql_r6('coalesce(s1, 0)')} AS weighted1, {sql_r6('coalesce(s2, 0)')} AS weighted2
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN a USING (l_orderkey)""")
def compact_sequence(spark, sf):
    """Sequences without padding-only steps, at most four steps long."""
    q = F.col("l_quantity")
    cells = F.array(F.when(q % 2 == 0, -1.0).otherwise(q), F.when(q % 3 == 0, -2.0).otherwise(F.col("l_discount")))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", cells.alias("c")).alias("s"))
    # an order has a handful of lines, so its sequence is gathered whole
    seqs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    seqs = seqs.select("l_orderkey", WIN.compact(F.transform("s", lambda x: x["c"]), 4).alias("x"))

    def weighted(j):
        return F.aggregate(F.transform("x", lambda r, i: F.get(r, F.lit(j)) * (i + 1)), F.lit(0.0), lambda a, b: a + b)

    return seqs.select("l_orderkey", WIN.compact_length(F.col("x")).alias("length"), r6(weighted(0)).alias("weighted1"),
                       r6(weighted(1)).alias("weighted2"))


@query("dense_tensor", f"""WITH r AS (SELECT l_orderkey, l_quantity AS a, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS b,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS t FROM lineitem),
g AS (SELECT l_orderkey, unnest(range(1, 6)) AS t FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT l_orderkey, CAST(g.t - 1 AS INT) AS t, coalesce(a, -1.0) AS c0, coalesce(b, -1.0) AS c1 FROM g LEFT JOIN r USING (l_orderkey, t)""")
def dense_tensor(spark, sf):
    """Fixed 5 x 2 tensors: missing cells and steps padded, longer sequences cut."""
    b = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    li = table(spark, sf, "lineitem").withColumn("b", b)
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
                                            WIN.dense_cells(["l_quantity", "b"], -1.0).alias("c")).alias("s"))
    seqs = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    cells = WIN.tensor(F.transform("s", lambda x: x["c"]), 5, 2, -1.0)
    return seqs.select("l_orderkey", F.posexplode(cells).alias("t", "c")).select(
        "l_orderkey", "t", F.get("c", 0).alias("c0"), F.get("c", 1).alias("c1"))


@query("global_window_size", """SELECT (SELECT max(l_linenumber) + 1 FROM lineitem)::BIGINT AS by_index,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))::BIGINT AS by_length""")
def global_window_size(spark, sf):
    """Window length from the largest position and from the longest sequence."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    per = li.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"), F.max("l_linenumber").alias("m"))
    return per.agg(WIN.size_from_index("m").alias("by_index"), WIN.size_from_arrays("a").alias("by_length"))
