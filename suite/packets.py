"""Per-packet queries: coercion, encodings, list parsing, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions import risk as R
from railtap.functions import scalars as S
from railtap.operators import attack as A
from railtap.operators import evaluate as EV
from railtap.operators import match as M
from suite.base import packets, pkt_sql, query, r6, sql_r6, table


@query("packet_view", f"""WITH {pkt_sql('seq', 'capture', 'protocol', 'sip', 'dp', 'len', 'ts_us')}
SELECT seq, capture, CASE WHEN protocol = 'xgt-fen' THEN 'xgt_fen' ELSE protocol END AS protocol,
 CASE protocol WHEN 's7comm' THEN 1 WHEN 'tcp' THEN 2 WHEN 'xgt_fen' THEN 3 WHEN 'modbus' THEN 4 WHEN 'arp' THEN 5
  WHEN 'udp' THEN 6 WHEN 'unknown' THEN 7 WHEN 'dns' THEN 8 ELSE 0 END AS code,
 sip, CAST(dp AS BIGINT) AS dp, CAST(len AS BIGINT) AS len, ts_us // 1000 AS ts_ms FROM pkt""")
def packet_view(spark, sf):
    """Packets with aliases resolved, protocol encoded and ports coerced."""
    p = packets(spark, sf, "seq", "capture", "protocol", "sip", "dp", "len", "ts_us")
    return p.select("seq", "capture", S.protocol_alias(F.col("protocol")).alias("protocol"),
                    S.protocol_code(F.col("protocol")).alias("code"), "sip",
                    C.to_int(F.col("dp")).alias("dp"), C.to_int(F.col("len")).alias("len"),
                    F.floor(F.col("ts_us") / 1000).alias("ts_ms"))


# One text per row that walks through every shape the coercions meet.
_SHAPE = ("CASE event_id % 12 WHEN 0 THEN {k} WHEN 1 THEN concat('0x', {k}) WHEN 2 THEN concat({k}, '.0')"
          " WHEN 3 THEN concat({k}, '.5') WHEN 4 THEN concat(' ', {k}, ' ') WHEN 5 THEN concat('0', {k})"
          " WHEN 6 THEN '' WHEN 7 THEN concat('-', {k}) WHEN 8 THEN 'abc' WHEN 9 THEN concat({k}, 'e1')"
          " WHEN 10 THEN concat('[', {k}, ',8]') ELSE NULL END")
_K_DUCK = "json_extract_string(props, '$.k')"
_FLOATISH = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _shapes(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return ev.select(F.col("event_id").alias("seq"), F.expr(_SHAPE.replace("{k}", "k")).alias("v"))


_SHAPE_CTE = f"""s AS (SELECT seq, v, trim(v) AS t, trim(CASE WHEN trim(v) LIKE '[%]' THEN json_extract_string(v, '$[0]') ELSE v END) AS h
 FROM (SELECT event_id AS seq, {_SHAPE.replace('{k}', _K_DUCK)} AS v FROM events))"""


@query("coerce_props", f"""WITH {_SHAPE_CTE} SELECT seq,
 CASE WHEN t LIKE '0x%' THEN TRY_CAST(t AS BIGINT) WHEN regexp_matches(t, '^-?[0-9]+$') THEN TRY_CAST(t AS BIGINT) END AS as_i,
 CASE WHEN t LIKE '0x%' OR regexp_matches(t, '^-?[0-9]+$') THEN NULL WHEN regexp_matches(t, '[.eE]') AND regexp_matches(t, '{_FLOATISH}')
   THEN TRY_CAST(t AS DOUBLE) END AS as_d,
 CASE WHEN t LIKE '0x%' OR regexp_matches(t, '^-?[0-9]+$') OR (regexp_matches(t, '[.eE]') AND regexp_matches(t, '{_FLOATISH}'))
   THEN NULL ELSE v END AS as_s,
 CASE WHEN t LIKE '0x%' THEN TRY_CAST(t AS BIGINT) WHEN regexp_matches(t, '{_FLOATISH}') AND TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE))
   THEN CAST(TRY_CAST(t AS DOUBLE) AS BIGINT) END AS whole,
 coalesce(CASE WHEN h LIKE '0x%' OR regexp_matches(h, '^[+-]?(0+|[1-9][0-9]*)$') THEN TRY_CAST(h AS BIGINT) END, 0) AS safe_i,
 coalesce(CASE WHEN h LIKE '0x%' OR regexp_matches(h, '^[+-]?[0-9]+$') THEN TRY_CAST(h AS BIGINT) END, 0) AS offline_i,
 coalesce(CASE WHEN regexp_matches(h, '{_FLOATISH}') THEN TRY_CAST(h AS DOUBLE) END, -1.0) AS safe_d,
 CASE WHEN t LIKE '0x%' THEN TRY_CAST(t AS BIGINT) WHEN regexp_matches(t, '{_FLOATISH}') THEN CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT) END AS hex_i
FROM s""")
def coerce_props(spark, sf):
    """Every scalar coercion over texts of mixed shape."""
    v = F.col("v")
    t = C.coerce_scalar(v)
    return _shapes(spark, sf).select(
        "seq", t["i"].alias("as_i"), t["d"].alias("as_d"), t["s"].alias("as_s"), C.to_int(v).alias("whole"),
        C.safe_int(v).alias("safe_i"), C.safe_int_offline(v).alias("offline_i"), C.safe_float(v).alias("safe_d"),
        C.hex_or_decimal_int(v).alias("hex_i"))


@query("packet_text_parse", """SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k
 FROM events""")
def packet_text_parse(spark, sf):
    """Packets carried as JSON text; anything that is not one object is null."""
    ev = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return ev.select(F.col("event_id").alias("seq"), C.parse_packet_text(text, "k INT")["k"].alias("k"))


@query("tri_state_match", f"""WITH {pkt_sql('seq', 'match', 'delta_t', 'k')} SELECT seq,
 CASE WHEN "match" IN ('1','true','True','O','o','OK','ok') THEN 1.0::DOUBLE WHEN "match" IN ('0','false','False','X','x') THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS code,
 coalesce(TRY_CAST(nullif(delta_t, '') AS DOUBLE), -1.0) AS delta_t FROM pkt""")
def tri_state_match(spark, sf):
    """Match flag as 1 / 0 / -1 and the time delta with its default."""
    p = packets(spark, sf, "seq", "match", "delta_t", "k")
    return p.select("seq", C.match_code(F.col("match")).alias("code"), C.safe_float(F.col("delta_t")).alias("delta_t"))


def _sql_minmax(x, lo, hi):
    return (f"CASE WHEN {x} IS NULL OR {lo} IS NULL OR {hi} IS NULL THEN 0.0 WHEN {x} < {lo} OR {x} > {hi} THEN -2.0"
            f" WHEN {lo} = {hi} THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo} + 1e-9) END")


_SERVE_CODE = ("CASE protocol WHEN 's7comm' THEN 1 WHEN 'tcp' THEN 2 WHEN 'xgt_fen' THEN 3 WHEN 'modbus' THEN 4"
               " WHEN 'arp' THEN 5 WHEN 'udp' THEN 6 WHEN 'unknown' THEN 7 WHEN 'dns' THEN 8 ELSE 0 END")
_FIT_CODE = ("CASE protocol WHEN 's7comm' THEN 0 WHEN 'tcp' THEN 1 WHEN 'xgt_fen' THEN 2 WHEN 'modbus' THEN 3"
             " WHEN 'arp' THEN 4 WHEN 'udp' THEN 5 WHEN 'dns' THEN 6 ELSE -1 END")


@query("direction_protocol_norm", f"""WITH {pkt_sql('seq', 'protocol', 'dir', 'value', 'k')} SELECT seq,
 CASE WHEN dir = 'request' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dir_serve,
 CASE dir WHEN 'request' THEN 1.0::DOUBLE WHEN 'response' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS dir_fit,
 {_FIT_CODE} AS code_fit, {sql_r6(f'({_SERVE_CODE}) / (8.0 + 1e-9)')} AS norm_serve,
 {sql_r6(f'CASE WHEN {_FIT_CODE} < 0 THEN -1.0 ELSE {_FIT_CODE} / 6.0 END')} AS norm_fit,
 {sql_r6(_sql_minmax('value', '5.0', '40.0'))} AS value_norm,
 {sql_r6('(value - 5.0) / 35.0')} AS value_plain,
 CAST({_sql_minmax('value', '7.0', 'CASE WHEN k > 50 THEN 7.0 END')} AS DOUBLE) AS value_degenerate FROM pkt""")
def direction_protocol_norm(spark, sf):
    """Direction and protocol encodings and both min-max scalings."""
    p = packets(spark, sf, "seq", "protocol", "dir", "value", "k")
    code, fit = S.protocol_code(F.col("protocol")), S.protocol_code(F.col("protocol"), "fit")
    v = F.col("value")
    return p.select(
        "seq", S.direction_code(F.col("dir")).alias("dir_serve"), S.direction_code(F.col("dir"), "fit").alias("dir_fit"),
        fit.alias("code_fit"), r6(S.protocol_norm(code)).alias("norm_serve"),
        r6(S.protocol_norm(fit, "fit")).alias("norm_fit"),
        r6(S.minmax_sentinel(v, F.lit(5.0), F.lit(40.0))).alias("value_norm"),
        r6(S.minmax_plain(v, F.lit(5.0), F.lit(40.0))).alias("value_plain"),
        S.minmax_sentinel(v, F.lit(7.0), F.when(F.col("k") > 50, 7.0)).alias("value_degenerate"))


@query("iso_epoch_ms", """SELECT event_id AS seq,
 CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 1000 - 32400000 ELSE 0 END AS ms
 FROM events""")
def iso_epoch_ms(spark, sf):
    """ISO texts, naive, with Z and with an offset, to epoch milliseconds; junk gives 0."""
    ev = table(spark, sf, "events")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 4
    text = (F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("Z"))).when(k == 2, F.concat(t, F.lit("+09:00")))
            .otherwise(F.lit("soon")))
    return ev.select(F.col("event_id").alias("seq"), C.iso_epoch_ms(text).alias("ms"))


@query("nibbles_and_hex_profile", f"""WITH {pkt_sql('seq', 'xgt_fen_fenetpos', 'xgt_fen_data', 'k')},
b AS (SELECT seq, CAST(xgt_fen_fenetpos AS BIGINT) AS f, xgt_fen_data AS d, replace(xgt_fen_data, ' ', '') AS h FROM pkt),
x AS (SELECT *, CASE WHEN regexp_matches(h, '^([0-9A-Fa-f][0-9A-Fa-f])*$') THEN
  list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, CAST(i * 2 - 1 AS BIGINT), 2) AS INT)) END AS bytes FROM b)
SELECT seq, f >> 4 AS high, f & 15 AS low, CASE WHEN d IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing,
 CAST(coalesce(length(d), 0) AS DOUBLE) AS len_chars, CAST(coalesce(length(d) - length(h), 0) AS DOUBLE) AS num_spaces,
 CASE WHEN bytes IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_hex, CAST(coalesce(len(bytes), 0) AS DOUBLE) AS n_bytes,
 CASE WHEN len(bytes) > 0 THEN {sql_r6("len(list_filter(bytes, lambda v: v = 0)) / len(bytes)")} ELSE 0.0 END AS zero_ratio,
 CAST(coalesce(bytes[1], 0) AS DOUBLE) AS first_byte, CAST(coalesce(bytes[-1], 0) AS DOUBLE) AS last_byte,
 CASE WHEN len(bytes) > 0 THEN {sql_r6("list_avg(bytes)")} ELSE 0.0 END AS mean_byte,
 CASE WHEN coalesce(len(bytes), 0) = 0 OR list_avg(bytes) <= 64 THEN 0.0::DOUBLE WHEN list_avg(bytes) <= 128 THEN 1.0::DOUBLE
  WHEN list_avg(bytes) <= 192 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS bucket,
 coalesce(regexp_matches(lower(h), '^0+$'), false) AS all_zero, coalesce(substr(lower(h), 5, 4), '') AS word1 FROM x""")
def nibbles_and_hex_profile(spark, sf):
    """Rack position nibbles and the shape of hex payloads."""
    p = packets(spark, sf, "seq", "xgt_fen_fenetpos", "xgt_fen_data", "k")
    p = p.withColumn("bytes", S.payload_bytes(F.col("xgt_fen_data")))
    f = C.safe_int(F.col("xgt_fen_fenetpos"))
    prof = S.payload_stats(F.col("xgt_fen_data"), F.col("bytes"))
    text = S.normalized_hex(F.col("xgt_fen_data"))
    return p.select("seq", S.high_nibble(f).alias("high"), S.low_nibble(f).alias("low"),
                    *[(r6(e) if n in ("zero_ratio", "mean_byte") else e).alias(n) for n, e in prof.items()],
                    S.is_all_zero(text).alias("all_zero"), S.hex_word(text, 1).alias("word1"))


@query("list_parse_stats", f"""WITH {pkt_sql('seq', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_vars', 'xgt_fen_translated_addr', 'k')},
l AS (SELECT seq, CAST(modbus_regs_addr AS JSON)::BIGINT[] AS a, CAST(modbus_regs_val AS JSON)::BIGINT[] AS v,
 list_filter(list_transform(string_split(xgt_fen_vars, ','), lambda s: trim(s)), lambda s: s <> '') AS names,
 list_transform(CAST(xgt_fen_translated_addr AS JSON)::VARCHAR[], lambda s: CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)) AS d FROM pkt)
SELECT seq, CAST(len(a) AS DOUBLE) AS a_count, CAST(list_min(a) AS DOUBLE) AS a_min, CAST(list_max(a) AS DOUBLE) AS a_max,
 CAST(list_max(a) - list_min(a) AS DOUBLE) AS a_range, CAST(list_min(v) AS DOUBLE) AS v_min, CAST(list_max(v) AS DOUBLE) AS v_max,
 {sql_r6('list_avg(v)')} AS v_mean, {sql_r6('list_stddev_pop(v)')} AS v_std,
 names[1] AS first_name, CAST(len(names) AS INT) AS n_names, list_sum(d) AS addr_sum FROM l""")
def list_parse_stats(spark, sf):
    """Register lists, variable lists and address digits."""
    p = packets(spark, sf, "seq", "modbus_regs_addr", "modbus_regs_val", "xgt_fen_vars", "xgt_fen_translated_addr", "k")
    p = p.select("seq", C.int_list(F.col("modbus_regs_addr")).alias("a"), C.int_list(F.col("modbus_regs_val")).alias("v"),
                 C.name_list(F.col("xgt_fen_vars")).alias("names"),
                 C.address_numbers(F.col("xgt_fen_translated_addr")).alias("d"))
    a, v = S.range_stats(F.col("a")), S.moment_stats(F.col("v"))
    return p.select("seq", *[a[x].alias(f"a_{x}") for x in a], v["min"].alias("v_min"), v["max"].alias("v_max"),
                    r6(v["mean"]).alias("v_mean"), r6(v["std"]).alias("v_std"), F.get("names", 0).alias("first_name"),
                    F.size("names").alias("n_names"),
                    F.aggregate("d", F.lit(0.0), lambda x, y: x + y).alias("addr_sum"))


@query("stable_hash_bucket", f"""WITH {pkt_sql('seq', 'sip', 'dip', 'k')}
SELECT seq, CAST('0x' || substr(md5(sip || '-' || dip), 1, 8) AS BIGINT) % 1000 AS bucket FROM pkt""")
def stable_hash_bucket(spark, sf):
    """Stable bucket of an address pair."""
    p = packets(spark, sf, "seq", "sip", "dip", "k")
    return p.select("seq", S.stable_hash(F.concat_ws("-", "sip", "dip"), 1000).alias("bucket"))


_SQL_ASSET = """CASE WHEN {0} IS NULL OR {0} = '' THEN 0.6 WHEN {0} LIKE '%plc%' OR {0} LIKE '%rtu%' OR {0} LIKE '%dcs%' THEN 1.0
 WHEN {0} LIKE '%hmi%' OR {0} LIKE '%scada%' THEN 0.85 WHEN {0} LIKE '%hist%' THEN 0.8 WHEN {0} LIKE '%eng%' THEN 0.75
 WHEN {0} LIKE '%server%' THEN 0.7 WHEN {0} LIKE '%switch%' OR {0} LIKE '%router%' OR {0} LIKE '%fw%' OR {0} LIKE '%firewall%' THEN 0.65
 ELSE 0.6 END""".format
SQL_IMPACT = (f"least(({_SQL_ASSET('lower(dst_asset)')}) + CASE WHEN protocol IN ('modbus','xgt_fen','xgt-fen','s7comm','dnp3','bacnet')"
              " THEN 0.05 ELSE 0.0 END, 1.0)")


@query("asset_impact", f"""WITH {pkt_sql('seq', 'protocol', 'src_asset', 'dst_asset', 'k')}
SELECT seq, {sql_r6(SQL_IMPACT)} AS impact FROM pkt""")
def asset_impact(spark, sf):
    """Impact of the asset a packet goes to."""
    p = packets(spark, sf, "seq", "protocol", "src_asset", "dst_asset", "k")
    return p.select("seq", r6(R.impact(F.col("protocol"), F.col("src_asset"), F.col("dst_asset"))).alias("impact"))


@query("part_name_value", f"""SELECT p_partkey, CAST({_SQL_ASSET('lower(p_name)')} AS DOUBLE) AS asset_value FROM part""")
def part_name_value(spark, sf):
    """Asset value by keyword over arbitrary names."""
    return table(spark, sf, "part").select("p_partkey", R.asset_value(F.col("p_name")).alias("asset_value"))


@query("attack_flags", f"""WITH {pkt_sql('seq', 'protocol', 'modbus_fc', 'xgt_fen_cmd', 'xgt_fen_vars', 'xgt_fen_data', 'k')},
h AS (SELECT *, coalesce(lower(replace(xgt_fen_data, ' ', '')), '') AS hex FROM pkt),
w AS (SELECT *, protocol = 'xgt_fen' AND CAST(xgt_fen_cmd AS BIGINT) IN (88, 89) AS wr,
 protocol = 'modbus' AND CAST(modbus_fc AS BIGINT) = 6 AS fc6,
 protocol = 'xgt_fen' AND xgt_fen_vars = '%DB001046' AND hex <> '' AND NOT regexp_matches(hex, '^0+$') AS watched FROM h)
SELECT seq, wr OR fc6 AS modbus_fc6, wr OR (watched AND length(hex) >= 24 AND substr(hex, 21, 4) = '0000') AS xgt_last_zero,
 wr OR (watched AND length(hex) >= 20 AND substr(hex, 17, 4) = '0000') AS xgt_mid_zero,
 wr OR (watched AND length(hex) >= 4 AND substr(hex, 1, 4) <> '0500') AS xgt_head_zero, wr OR fc6 AS xgt_write_or_fc6,
 wr OR fc6 OR (watched AND length(hex) >= 4 AND substr(hex, 1, 4) <> '0500') AS xgt_write_or_fc6_after, wr AS other FROM w""")
def attack_flags(spark, sf):
    """Attack flag of every packet under each labelling mode."""
    p = packets(spark, sf, "seq", "protocol", "modbus_fc", "xgt_fen_cmd", "xgt_fen_vars", "xgt_fen_data", "k")
    return p.select("seq", *[A.attack_flag(F.lit(m), F.col("protocol"), F.col("modbus_fc"), F.col("xgt_fen_cmd"),
                                           F.col("xgt_fen_vars"), F.col("xgt_fen_data")).alias(m)
                             for m in (*A.MODES, "other")])


@query("labelling_mode", """SELECT page_id, CASE WHEN contains(f, 'ver5_2') THEN 'xgt_head_zero' WHEN contains(f, 'ver5_1') THEN 'xgt_mid_zero'
 WHEN contains(f, 'ver5') THEN 'xgt_last_zero' WHEN contains(f, 'ver2') OR contains(f, 'ver11') OR contains(f, 'attack') THEN 'xgt_write_or_fc6' ELSE 'modbus_fc6' END AS by_file,
 CASE page_id % 3 WHEN 0 THEN 'xgt_last_zero' WHEN 1 THEN 'xgt_mid_zero' ELSE 'xgt_head_zero' END AS by_alias
 FROM (SELECT page_id, 'cap_' || CASE page_id % 7 WHEN 0 THEN 'VER5X2' WHEN 1 THEN 'ver5_1' WHEN 2 THEN 'ver5_2' WHEN 3 THEN 'ver2' WHEN 4 THEN 'ver11'
  WHEN 5 THEN 'Attack' ELSE 'normal' END || '.jsonl' AS g, lower(g) AS f FROM pages)""")
def labelling_mode(spark, sf):
    """Labelling mode from a capture's file name and from mode aliases."""
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    tag = (F.when(i % 7 == 0, "VER5X2").when(i % 7 == 1, "ver5_1").when(i % 7 == 2, "ver5_2").when(i % 7 == 3, "ver2")
           .when(i % 7 == 4, "ver11").when(i % 7 == 5, "Attack").otherwise("normal"))
    path = F.concat(F.lit("/captures/attack/cap_"), tag, F.lit(".jsonl"))
    alias = F.when(i % 3 == 0, "xgt_d528_zero").when(i % 3 == 1, "xgt_d525_zero").otherwise("xgt_head_zero")
    return p.select("page_id", A.resolve_mode(F.lit("auto"), path).alias("by_file"),
                    A.resolve_mode(alias, path).alias("by_alias"))


# Text lines as an event labeller writes them: one in three lacks or blanks a field.
LINE = ("CASE seq % 9 WHEN 0 THEN concat('pkt @timestamp=', timestamp, ' sq=', sq, ' ak=', ak)"
        " WHEN 3 THEN concat('sq: ', sq, ' ak: ', ak, ' fl: ', fl) "
        " ELSE concat('pkt @timestamp=\"', timestamp, '\", sq=', sq, ', ak: \"', ak, '\" fl=', fl, '>') END")


@query("pls_regex_extract", f"""WITH {pkt_sql('seq', 'timestamp', 'sq', 'ak', 'fl', 'k')},
m AS (SELECT *, seq % 9 NOT IN (0, 3) AS ok FROM pkt)
SELECT seq, CASE WHEN ok THEN "timestamp" END AS ts, CASE WHEN ok THEN sq END AS sq, CASE WHEN ok THEN ak END AS ak,
 CASE WHEN ok THEN fl END AS fl, CASE WHEN seq % 9 NOT IN (0, 3) THEN "timestamp" END AS quoted_ts FROM m""")
def pls_regex_extract(spark, sf):
    """Match fields of labelled text lines; a line lacking one has none."""
    p = packets(spark, sf, "seq", "timestamp", "sq", "ak", "fl", "k").withColumn("line", F.expr(LINE))
    f = M.line_fields(F.col("line"))
    return p.select("seq", f["ts"].alias("ts"), f["sq"].alias("sq"), f["ak"].alias("ak"), f["fl"].alias("fl"),
                    M.quoted_timestamp(F.col("line")).alias("quoted_ts"))


@query("missing_field_profile", f"""WITH {pkt_sql('seq', 'dip', 'match', 'xgt_fen_data', 'modbus_bc', 'k')}
SELECT * FROM (
 SELECT 'dip' AS field, 'null' AS reason, count(*) FILTER (dip IS NULL) AS n FROM pkt UNION ALL
 SELECT 'dip', 'empty', count(*) FILTER (dip = '') FROM pkt UNION ALL
 SELECT 'match', 'null', count(*) FILTER ("match" IS NULL) FROM pkt UNION ALL
 SELECT 'match', 'empty', count(*) FILTER ("match" = '') FROM pkt UNION ALL
 SELECT 'xgt_fen_data', 'null', count(*) FILTER (xgt_fen_data IS NULL) FROM pkt UNION ALL
 SELECT 'xgt_fen_data', 'empty', count(*) FILTER (xgt_fen_data = '') FROM pkt UNION ALL
 SELECT 'modbus_bc', 'null', count(*) FILTER (modbus_bc IS NULL) FROM pkt UNION ALL
 SELECT 'modbus_bc', 'empty', count(*) FILTER (modbus_bc = '') FROM pkt) WHERE n > 0""")
def missing_field_profile(spark, sf):
    """How often each required field is null or empty."""
    return M.missing_profile(packets(spark, sf, "seq", "dip", "match", "xgt_fen_data", "modbus_bc", "k"),
                             ["dip", "match", "xgt_fen_data", "modbus_bc"])


@query("required_fields", f"""WITH {pkt_sql('seq', 'dip', 'match', 'k')}
SELECT seq FROM pkt WHERE coalesce(dip, '') <> '' AND coalesce("match", '') <> ''""")
def required_fields(spark, sf):
    """Packets whose required fields are all present."""
    p = packets(spark, sf, "seq", "dip", "match", "k")
    return p.where(M.has_all("dip", "match")).select("seq")


@query("noise_drop_label_counts", """SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lower(trim(lang)) NOT IN ('es')
 GROUP BY 1 ORDER BY n DESC, label LIMIT 10""")
def noise_drop_label_counts(spark, sf):
    """Most frequent labels once the dropped ones are out."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return EV.label_counts(EV.drop_labels(d, "label", ["es"], noise=True), "label")


@query("drop_list_totals", """SELECT count(*) AS total, count(*) FILTER (lang IN ('fr','de')) AS dropped,
 count(*) FILTER (lang IS NULL) AS missing_label, count(*) FILTER (lang NOT IN ('fr','de')) AS kept FROM documents""")
def drop_list_totals(spark, sf):
    """Kept, dropped and unlabelled totals of a labelled table."""
    lang = F.col("lang")
    gone = lang.isin("fr", "de")
    return table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("dropped"),
        F.count_if(lang.isNull()).alias("missing_label"), F.count_if(~gone).alias("kept"))


@query("alias_columns", f"""WITH {pkt_sql('seq', 'xgt_fen_len', 'k')} SELECT seq, xgt_fen_len AS first_len, CAST(NULL AS VARCHAR) AS absent FROM pkt""")
def alias_columns(spark, sf):
    """First of several alias columns that exists."""
    p = packets(spark, sf, "seq", "xgt_fen_len", "k")
    return p.select("seq", C.first_present(p, ["xgt_len", "xgt_fen_regs_len", "xgt_fen_len"]).alias("first_len"),
                    C.first_present(p, ["xgt_nothing"]).alias("absent"))


@query("protocol_subset", f"""WITH {pkt_sql('seq', 'protocol')} SELECT seq, protocol FROM pkt WHERE protocol IN ('modbus', 'xgt_fen', 'xgt-fen')""")
def protocol_subset(spark, sf):
    """Only the chosen protocols, either spelling of XGT."""
    p = packets(spark, sf, "seq", "protocol")
    return p.where(M.protocol_in(F.col("protocol"), ["modbus", "xgt_fen"])).select("seq", "protocol")
