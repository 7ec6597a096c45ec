"""Label matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.operators import match as M
from railtap.operators.order import track_for
from suite.base import packets, pkt_sql, query, table

# Lines are derived from packets: the timestamp is cut to the hour so that keys
# repeat, every third line asks for a key shifted out of reach, every seventh
# lacks a field; eight consecutive lines form a labelled pattern.
_KEYED = f"""{pkt_sql('seq', 'timestamp', 'sq', 'ak', 'fl', 'sip', 'k')},
raw AS (SELECT seq, substr("timestamp", 1, 10) AS ts, CAST(k % 10 AS VARCHAR) AS sq, ak, fl, sip FROM pkt WHERE seq % 4 <> 1),
lines AS (SELECT seq AS line_id, seq // 8 AS window_id, substr("timestamp", 1, 10) AS ts, CAST(k % 10 AS VARCHAR) AS sq,
 CASE WHEN seq % 3 = 0 THEN '9' ELSE ak END AS ak, CASE WHEN seq % 7 = 0 THEN NULL ELSE fl END AS fl FROM pkt),
r AS (SELECT *, row_number() OVER (PARTITION BY ts, sq, ak, fl ORDER BY seq) AS nth FROM raw),
l AS (SELECT *, row_number() OVER (PARTITION BY ts, sq, ak, fl ORDER BY line_id) AS nth FROM lines WHERE fl IS NOT NULL)"""


def _sides(spark, sf):
    p = packets(spark, sf, "seq", "timestamp", "sq", "ak", "fl", "sip", "k")
    day, sq = F.substring("timestamp", 1, 10).alias("ts"), (F.col("k") % 10).cast("string").alias("sq")
    raw = p.where(F.col("seq") % 4 != 1).select("seq", day, sq, "ak", "fl", "sip")
    lines = p.select(F.col("seq").alias("line_id"), F.floor(F.col("seq") / 8).alias("window_id"), day, sq,
                     F.when(F.col("seq") % 3 == 0, "9").otherwise(F.col("ak")).alias("ak"),
                     F.when(F.col("seq") % 7 != 0, F.col("fl")).alias("fl"))
    return lines, raw, track_for(lines, (), "line_id"), track_for(raw, (), "seq")


@query("match_fifo", f"""WITH {_KEYED} SELECT l.window_id, l.line_id, r.seq, r.sip, 'O' AS "match" FROM l JOIN r USING (ts, sq, ak, fl, nth)""")
def match_fifo(spark, sf):
    """Each line takes the next unused packet with its key."""
    lines, raw, lt, rt = _sides(spark, sf)
    return M.match_fifo(lines, raw, M.MATCH_KEYS, lt, rt).select("window_id", "line_id", "seq", "sip", "match")


@query("match_coverage", f"""WITH {_KEYED}, j AS (SELECT l.window_id, r.seq FROM l LEFT JOIN r USING (ts, sq, ak, fl, nth))
SELECT (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM lines WHERE fl IS NULL) AS no_fields, count(*) FILTER (seq IS NULL) AS missed,
 count(seq) AS matched, (SELECT count(DISTINCT window_id) FROM lines) AS windows, count(DISTINCT window_id) FILTER (seq IS NOT NULL) AS matched_windows FROM j""")
def match_coverage(spark, sf):
    """How much of the labelled lines found a packet."""
    lines, raw, lt, rt = _sides(spark, sf)
    return M.fifo_coverage(lines, raw, M.MATCH_KEYS, "window_id", lt, rt)


_WHOLE = f"""{pkt_sql('seq', 'timestamp', 'sip', 'k')},
raw AS (SELECT "timestamp" AS ts, last(sip ORDER BY seq) AS sip, max(seq) AS seq FROM pkt WHERE seq % 61 <> 0 GROUP BY 1),
lines AS (SELECT seq AS line_no, seq // 10 AS window_id, CASE WHEN seq % 9 = 0 THEN NULL ELSE "timestamp" END AS ts FROM pkt),
j AS (SELECT lines.*, raw.seq, raw.sip FROM lines LEFT JOIN raw USING (ts) WHERE lines.ts IS NOT NULL),
ok AS (SELECT window_id FROM j GROUP BY 1 HAVING count(*) = count(seq))"""


def _whole_sides(spark, sf):
    p = packets(spark, sf, "seq", "timestamp", "sip", "k")
    raw = p.where(F.col("seq") % 61 != 0).select(F.col("timestamp").alias("ts"), "seq", "sip")
    raw = raw.unionByName(raw.withColumn("sip", F.lit("early")).withColumn("seq", F.col("seq") - 1))
    lines = p.select(F.col("seq").alias("line_no"), F.floor(F.col("seq") / 10).alias("window_id"),
                     F.when(F.col("seq") % 9 != 0, F.col("timestamp")).alias("ts"))
    return lines, raw


@query("match_all_or_nothing", f"""WITH {_WHOLE} SELECT window_id, line_no, seq, sip FROM j JOIN ok USING (window_id)""")
def match_all_or_nothing(spark, sf):
    """Windows all of whose lines matched; the last packet of a timestamp counts."""
    lines, raw = _whole_sides(spark, sf)
    return M.match_whole(lines, raw, "ts", "window_id", "seq").select("window_id", "line_no", "seq", "sip")


@query("whole_coverage", f"""WITH {_WHOLE} SELECT (SELECT count(DISTINCT window_id) FROM lines) AS windows, (SELECT count(*) FROM ok) AS "full",
 (SELECT count(DISTINCT window_id) FROM lines) - (SELECT count(*) FROM ok) AS dropped""")
def whole_coverage(spark, sf):
    """Windows kept and dropped by the all-or-nothing match."""
    lines, raw = _whole_sides(spark, sf)
    return M.whole_coverage(lines, raw, "ts", "window_id")


# Patterns are sub-sequences of order lines: the order is the window, a key is
# made of part and return flag so that it repeats within an order.
_PATTERN = """w AS (SELECT l_orderkey AS window_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS pos,
 CAST(l_partkey % 3 AS VARCHAR) AS ts, l_returnflag AS sq FROM lineitem),
p AS (SELECT l_orderkey * 2 AS pattern_id, l_orderkey AS window_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS line_no, CAST(l_partkey % 3 AS VARCHAR) AS ts,
  CASE WHEN l_suppkey % 17 = 0 THEN 'Z' ELSE l_returnflag END AS sq, CASE WHEN l_orderkey % 11 = 0 THEN ' Noise ' ELSE 'scan' END AS label FROM lineitem WHERE l_linenumber % 2 = 1
 UNION ALL SELECT l_orderkey * 2 + 1, -l_orderkey, l_linenumber, '0', 'A', 'scan' FROM lineitem WHERE l_linenumber = 7),
wn AS (SELECT *, row_number() OVER (PARTITION BY window_id, ts, sq ORDER BY pos) AS nth FROM w),
pn AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, ts, sq ORDER BY line_no) AS nth FROM p WHERE lower(trim(label)) <> 'noise'),
j AS (SELECT pn.*, wn.pos FROM pn LEFT JOIN wn USING (window_id, ts, sq, nth)),
ok AS (SELECT pattern_id FROM j GROUP BY 1 HAVING count(*) = count(pos))"""


def _pattern_sides(spark, sf):
    from pyspark.sql import Window as W
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount")
    ts = (F.col("l_partkey") % 3).cast("string").alias("ts")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")) - 1
    windows = li.select(F.col("l_orderkey").alias("window_id"), place.alias("pos"), ts, F.col("l_returnflag").alias("sq"))
    odd = li.where(F.col("l_linenumber") % 2 == 1).select(
        (F.col("l_orderkey") * 2).alias("pattern_id"), F.col("l_orderkey").alias("window_id"),
        ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("line_no"), ts,
        F.when(F.col("l_suppkey") % 17 == 0, "Z").otherwise(F.col("l_returnflag")).alias("sq"),
        F.when(F.col("l_orderkey") % 11 == 0, " Noise ").otherwise("scan").alias("label"))
    lost = li.where("l_linenumber = 7").select(
        (F.col("l_orderkey") * 2 + 1).alias("pattern_id"), (-F.col("l_orderkey")).alias("window_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"), F.lit("0").alias("ts"), F.lit("A").alias("sq"),
        F.lit("scan").alias("label"))
    return odd.unionByName(lost), windows


@query("window_index", f"""WITH {_PATTERN} SELECT pattern_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY line_no, pos) AS "index" FROM j JOIN ok USING (pattern_id) GROUP BY pattern_id""")
def window_index(spark, sf):
    """Positions of pattern lines in their windows."""
    patterns, windows = _pattern_sides(spark, sf)
    patterns = patterns.where(F.lower(F.trim("label")) != "noise")
    pos = M.pattern_positions(patterns, windows, ["ts", "sq"], "window_id", "pattern_id", "line_no", "pos")
    idx = M.position_array(pos, "pattern_id", "line_no", "pos")
    return idx.select("pattern_id", F.array_join(F.transform("index", lambda x: x.cast("string")), ",").alias("index"))


@query("pattern_skip_reasons", f"""WITH {_PATTERN}, h AS (SELECT pattern_id, first(window_id) AS window_id, bool_or(lower(trim(label)) = 'noise') AS noise FROM p GROUP BY 1)
SELECT CASE WHEN noise THEN 'noise' WHEN window_id NOT IN (SELECT window_id FROM w) THEN 'unknown_window' WHEN pattern_id NOT IN (SELECT pattern_id FROM ok) THEN 'unmatched'
 ELSE 'written' END AS reason, count(*) AS n FROM h GROUP BY 1""")
def pattern_skip_reasons(spark, sf):
    """Why patterns got no positions."""
    patterns, windows = _pattern_sides(spark, sf)
    return M.skip_reasons(patterns, windows, ["ts", "sq"], "window_id", "pattern_id", "line_no", "pos", "label")


@query("key_union_intersection", f"""WITH {pkt_sql('seq', 'k', 'user_id')}, s AS (SELECT CASE WHEN k < 50 THEN 'a' ELSE 'b' END AS side, user_id FROM pkt)
SELECT user_id, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b FROM s GROUP BY user_id""")
def key_union_intersection(spark, sf):
    """Union of two key sets with membership of each."""
    s = packets(spark, sf, "seq", "k", "user_id")
    return s.groupBy("user_id").agg(F.bool_or(F.col("k") < 50).alias("in_a"), F.bool_or(F.col("k") >= 50).alias("in_b"))
