"""Fitting and featurising queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions import scalars as S
from railtap.operators import features as X
from railtap.operators import fit as FT
from railtap.schema import BASE_FEATURES
from suite.base import packets, pkt_sql, query, r6, round_doubles, sql_r6, table

# --- SQL side of the raw feature values ----------------------------------------

_NUM = "CAST({} AS DOUBLE)".format
_PROTO = {"modbus": "modbus", "s7comm": "s7comm", "xgt": "xgt_fen", "dns": "dns", "arp": "arp"}


def _owner(feature: str) -> str | None:
    return next((p for k, p in _PROTO.items() if feature.startswith(k)), None)


_RAW = {
    "sp_norm": _NUM("sp"), "dp_norm": _NUM("dp"), "len_norm": _NUM("len"),
    "s7comm_ros_norm": _NUM("s7comm_ros"), "s7comm_db_norm": _NUM("s7comm_db"), "s7comm_addr_norm": _NUM("s7comm_addr"),
    "modbus_addr_norm": _NUM("modbus_addr"), "modbus_fc_norm": _NUM("modbus_fc"), "modbus_qty_norm": _NUM("modbus_qty"),
    "modbus_bc_norm": "coalesce(TRY_CAST(nullif(modbus_bc, '') AS DOUBLE), 0.0)",
    "modbus_regs_count": _NUM("len(addrs)"), "modbus_regs_addr_min": _NUM("list_min(addrs)"),
    "modbus_regs_addr_max": _NUM("list_max(addrs)"), "modbus_regs_addr_range": _NUM("list_max(addrs) - list_min(addrs)"),
    "modbus_regs_val_min": _NUM("list_min(vals)"), "modbus_regs_val_max": _NUM("list_max(vals)"),
    "modbus_regs_val_mean": "list_avg(vals)", "modbus_regs_val_std": "list_stddev_pop(vals)",
    "xgt_var_cnt": "CASE WHEN coalesce(xgt_fen_vars, '') <> '' THEN 1.0 ELSE 0.0 END", "xgt_source": _NUM("CAST(xgt_fen_source AS BIGINT)"),
    "xgt_fenet_base": _NUM("CAST(xgt_fen_fenetpos AS BIGINT) >> 4"), "xgt_fenet_slot": _NUM("CAST(xgt_fen_fenetpos AS BIGINT) & 15"),
    "xgt_cmd": _NUM("CAST(xgt_fen_cmd AS BIGINT)"), "xgt_dtype": _NUM("CAST(xgt_fen_dtype AS BIGINT)"), "xgt_blkcnt": _NUM("xgt_fen_blkcnt"),
    "xgt_err_code": _NUM("xgt_fen_errinfo"), "xgt_datasize": _NUM("xgt_fen_datasize"),
    "xgt_data_len_chars": "CAST(coalesce(length(xgt_fen_data), 0) AS DOUBLE)",
    "xgt_data_num_spaces": "CAST(coalesce(length(xgt_fen_data) - length(hex), 0) AS DOUBLE)",
    "xgt_data_n_bytes": "CAST(coalesce(len(bytes), 0) AS DOUBLE)",
    "dns_qc_norm": _NUM("dns_qc"), "dns_ac_norm": _NUM("dns_ac"),
}
_RAW_FIT = {
    "sp_norm": _NUM("sp"), "dp_norm": _NUM("dp"), "len_norm": _NUM("len"), "s7comm_ros_norm": _NUM("s7comm_ros"),
    "s7comm_fn_norm": _NUM("CAST(s7comm_fn AS BIGINT)"), "s7comm_ic_norm": _NUM("s7comm_ic"), "s7comm_db_norm": _NUM("s7comm_db"),
    "s7comm_addr_norm": _NUM("s7comm_addr"), "modbus_tid_norm": _NUM("modbus_tid"), "modbus_fc_norm": _NUM("modbus_fc"),
    "modbus_addr_norm": _NUM("modbus_addr"), "modbus_qty_norm": _NUM("modbus_qty"), "modbus_bc_norm": "TRY_CAST(nullif(modbus_bc, '') AS DOUBLE)",
    "xgt_var_cnt_norm": "CASE WHEN xgt_fen_vars <> '' THEN CAST(len(string_split(xgt_fen_vars, ',')) AS DOUBLE) END",
    "xgt_fenet_base_norm": _NUM("(CAST(xgt_fen_fenetpos AS BIGINT) >> 4) & 15"), "xgt_fenet_slot_norm": _NUM("CAST(xgt_fen_fenetpos AS BIGINT) & 15"),
    "xgt_err_code_norm": _NUM("CAST(xgt_fen_errstat AS BIGINT)"), "xgt_source_norm": _NUM("CAST(xgt_fen_source AS BIGINT)"),
    "xgt_len_norm": _NUM("xgt_fen_len"), "xgt_cmd_norm": _NUM("CAST(xgt_fen_cmd AS BIGINT)"), "xgt_dtype_norm": _NUM("CAST(xgt_fen_dtype AS BIGINT)"),
    "xgt_blkcnt_norm": _NUM("xgt_fen_blkcnt"), "xgt_datasize_norm": _NUM("xgt_fen_datasize"), "arp_op_num": _NUM("arp_op"),
    "dns_tid_norm": _NUM("CAST(dns_tid AS BIGINT)"), "dns_fl_norm": _NUM("CAST(dns_fl AS BIGINT)"), "dns_qc_norm": _NUM("dns_qc"), "dns_ac_norm": _NUM("dns_ac"),
}


def _guard(feature: str, e: str) -> str:
    own = _owner(feature)
    return f"CASE WHEN protocol = '{own}' THEN {e} END" if own else e


_PARSED = f"""{pkt_sql()},
parsed AS (SELECT *, CAST(coalesce(modbus_translated_addr, modbus_regs_addr) AS JSON)::BIGINT[] AS addrs, CAST(modbus_regs_val AS JSON)::BIGINT[] AS vals,
 CAST(modbus_regs_addr AS JSON)::DOUBLE[] AS fit_addrs, replace(xgt_fen_data, ' ', '') AS hex FROM pkt),
shaped AS (SELECT *, CASE WHEN regexp_matches(hex, '^([0-9A-Fa-f][0-9A-Fa-f])*$') THEN
  list_transform(range(1, length(hex) // 2 + 1), lambda i: CAST('0x' || substr(hex, CAST(i * 2 - 1 AS BIGINT), 2) AS INT)) END AS bytes FROM parsed),
raws AS (SELECT *, {', '.join(f'{_guard(f, e)} AS r_{f}' for f, e in _RAW.items())},
 {', '.join(f'{_guard(f, e)} AS f_{f}' for f, e in _RAW_FIT.items())} FROM shaped),
lim AS (SELECT {', '.join(f'min(coalesce(r_{f}, 0.0)) AS rlo_{f}, max(coalesce(r_{f}, 0.0)) AS rhi_{f}' for f in _RAW)},
 {', '.join(f'min(coalesce(f_{f}, 0.0)) AS flo_{f}, max(coalesce(f_{f}, 0.0)) AS fhi_{f}' for f in _RAW_FIT)} FROM raws)"""

_TOKEN = "CASE WHEN trim({0}) <> '' AND trim({1}) <> '' THEN trim({0}) || '|' || trim({1}) END".format


def _vocab_cte(name: str, *tokens: str) -> str:
    union = " UNION ".join(f"SELECT {t} AS token FROM pkt" for t in tokens)
    return f"{name} AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM ({union}) WHERE token IS NOT NULL)"


_HOSTS = _vocab_cte("hosts", _TOKEN("sip", "smac"), _TOKEN("dip", "dmac"))
_ARPS = _vocab_cte("arps", f"CASE WHEN protocol = 'arp' THEN {_TOKEN('sip', 'smac')} END",
                   f"CASE WHEN protocol = 'arp' THEN {_TOKEN('arp_tip', 'arp_tmac')} END")
_FIRST_VAR = "CASE WHEN protocol = 'xgt_fen' THEN nullif(split_part(xgt_fen_vars, ',', 1), '') END"
_VARS = f"vars AS (SELECT name, row_number() OVER (ORDER BY seen) AS id FROM (SELECT {_FIRST_VAR} AS name, min(seq) AS seen FROM pkt GROUP BY 1) WHERE name IS NOT NULL)"
_SLOTS = """pairs AS (SELECT seq, protocol AS proto, unnest(list_zip(CAST(modbus_translated_addr AS JSON)::VARCHAR[], (CAST(modbus_regs_val AS JSON)::DOUBLE[])[1:2])) AS p, 1 AS o
  FROM pkt WHERE protocol = 'modbus' AND modbus_translated_addr IS NOT NULL
 UNION ALL SELECT seq, protocol, unnest(list_zip(CAST(xgt_fen_translated_addr AS JSON)::VARCHAR[], CAST(xgt_fen_word_value AS JSON)::DOUBLE[])), 1 FROM pkt WHERE protocol = 'xgt_fen'),
slots AS (SELECT proto, addr, vmin, vmax, row_number() OVER (PARTITION BY proto ORDER BY CASE WHEN proto = 'modbus' THEN CAST(addr AS BIGINT) END, addr) - 1 AS slot
 FROM (SELECT proto, p[1] AS addr, min(p[2]) AS vmin, max(p[2]) AS vmax FROM pairs GROUP BY ALL))"""


def _fitted(spark, sf) -> tuple:
    p = packets(spark, sf)
    return p, X.fit(p)


# --- fitting ---------------------------------------------------------------------

@query("fit_minmax", f"WITH {_PARSED} " + " UNION ALL ".join(
    [f"SELECT '{f}' AS feature, {sql_r6(f'rlo_{f}')} AS vmin, {sql_r6(f'rhi_{f}')} AS vmax FROM lim" for f in _RAW]
    + [f"SELECT 'fit_{f}', {sql_r6(f'flo_{f}')}, {sql_r6(f'fhi_{f}')} FROM lim" for f in _RAW_FIT]))
def fit_minmax(spark, sf):
    """Range of every scaled feature, fitted in one pass."""
    p = X.with_parsed(packets(spark, sf))
    return round_doubles(FT.ranges(p, X.raw_values(p) | X.raw_values_fit(p)))


@query("fit_host_vocab", f"WITH {pkt_sql('sip', 'smac', 'dip', 'dmac', 'k')}, {_HOSTS} SELECT token, id FROM hosts")
def fit_host_vocab(spark, sf):
    """Host vocabulary over source and target endpoints."""
    p = packets(spark, sf, "sip", "smac", "dip", "dmac", "k")
    return FT.sorted_vocabulary(p, [FT.host_token(F.col("sip"), F.col("smac")), FT.host_token(F.col("dip"), F.col("dmac"))])


@query("fit_first_seen_vocab", f"WITH {pkt_sql('seq', 'protocol', 'xgt_fen_vars', 'k')}, {_VARS} SELECT name, id FROM vars")
def fit_first_seen_vocab(spark, sf):
    """Variable vocabulary in order of first use."""
    p = packets(spark, sf, "seq", "protocol", "xgt_fen_vars", "k")
    name = F.when(F.col("protocol") == "xgt_fen", F.get(C.name_list(F.col("xgt_fen_vars")), 0))
    return FT.first_seen_vocabulary(p, name, "seq")


@query("fit_slot_minmax", """SELECT 'part' AS proto, CAST(l_partkey % 20 AS VARCHAR) AS addr, min(l_quantity) AS vmin, max(l_quantity) AS vmax FROM lineitem GROUP BY ALL""")
def fit_slot_minmax(spark, sf):
    """Range per address over long measurements."""
    li = table(spark, sf, "lineitem")
    p = li.select(F.lit("part").alias("protocol"),
                  F.concat(F.lit("["), (F.col("l_partkey") % 20).cast("string"), F.lit("]")).alias("a"),
                  F.concat(F.lit("["), F.col("l_quantity").cast("string"), F.lit("]")).alias("v"))
    return FT.slot_ranges(p, {"part": ("a", "v")})


@query("fit_slot_ids", f"WITH {pkt_sql('seq', 'protocol', 'modbus_translated_addr', 'modbus_regs_val', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'k')}, {_SLOTS} SELECT proto, addr, vmin, vmax, slot FROM slots")
def fit_slot_ids(spark, sf):
    """Slot ids and ranges of both register protocols."""
    p = packets(spark, sf, "seq", "protocol", "modbus_translated_addr", "modbus_regs_val", "xgt_fen_translated_addr",
                "xgt_fen_word_value", "k")
    return FT.number_slots(FT.slot_ranges(p, X.SLOT_FIT_COLUMNS))


# --- featurising -------------------------------------------------------------------

def _sql_scale(f: str) -> str:
    x, lo, hi = f"r_{f}", f"rlo_{f}", f"rhi_{f}"
    e = f"CASE WHEN {x} IS NULL THEN 0.0 WHEN {x} < {lo} OR {x} > {hi} THEN -2.0 WHEN {lo} = {hi} THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo} + 1e-9) END"
    own = _owner(f)
    return f"CASE WHEN protocol = '{own}' THEN {e} ELSE -1.0 END" if own else e


def _mine(proto: str, e: str) -> str:
    return f"CASE WHEN protocol = '{proto}' THEN CAST({e} AS DOUBLE) ELSE -1.0 END"


_SERVE_SQL = {f: _sql_scale(f) for f in _RAW} | {
    "protocol_norm": "(CASE protocol WHEN 's7comm' THEN 1 WHEN 'xgt_fen' THEN 3 WHEN 'modbus' THEN 4 WHEN 'arp' THEN 5 WHEN 'dns' THEN 8 END) / (8.0 + 1e-9)",
    "dir_code": "CASE WHEN dir = 'request' THEN 1.0 ELSE 0.0 END",
    "src_host_id": "CAST(coalesce(hs.id, 0) AS DOUBLE)", "dst_host_id": "CAST(coalesce(hd.id, 0) AS DOUBLE)",
    "s7comm_fn": _mine("s7comm", "CAST(s7comm_fn AS BIGINT)"),
    "xgt_var_id": _mine("xgt_fen", "coalesce(vv.id, 0)"),
    "xgt_err_flag": _mine("xgt_fen", "CASE WHEN CAST(xgt_fen_errstat AS BIGINT) <> 0 OR CAST(xgt_fen_errinfo AS BIGINT) <> 0 THEN 1.0 ELSE 0.0 END"),
    "xgt_data_missing": _mine("xgt_fen", "CASE WHEN xgt_fen_data IS NULL THEN 1.0 ELSE 0.0 END"),
    "xgt_data_is_hex": _mine("xgt_fen", "CASE WHEN bytes IS NULL THEN 0.0 ELSE 1.0 END"),
    "xgt_data_zero_ratio": _mine("xgt_fen", "CASE WHEN len(bytes) > 0 THEN len(list_filter(bytes, lambda v: v = 0)) / len(bytes) ELSE 0.0 END"),
    "xgt_data_first_byte": _mine("xgt_fen", "coalesce(bytes[1], 0)"), "xgt_data_last_byte": _mine("xgt_fen", "coalesce(bytes[-1], 0)"),
    "xgt_data_mean_byte": _mine("xgt_fen", "coalesce(list_avg(bytes), 0.0)"),
    "xgt_data_bucket": _mine("xgt_fen", "CASE WHEN coalesce(list_avg(bytes), 0) <= 64 THEN 0 WHEN list_avg(bytes) <= 128 THEN 1 WHEN list_avg(bytes) <= 192 THEN 2 ELSE 3 END"),
    "arp_src_host_id": _mine("arp", "coalesce(as_.id, 0)"), "arp_tgt_host_id": _mine("arp", "coalesce(at_.id, 0)"),
    "arp_op_num": _mine("arp", "CAST(arp_op AS BIGINT)"),
}
_FEATURE_FROM = f"""FROM raws CROSS JOIN lim LEFT JOIN hosts hs ON hs.token = {_TOKEN('sip', 'smac')} LEFT JOIN hosts hd ON hd.token = {_TOKEN('dip', 'dmac')}
 LEFT JOIN arps as_ ON as_.token = {_TOKEN('sip', 'smac')} LEFT JOIN arps at_ ON at_.token = {_TOKEN('arp_tip', 'arp_tmac')}"""
_FEATURE_SQL = f"""WITH {_PARSED}, {_HOSTS}, {_ARPS}, {_VARS}
SELECT seq, CAST(CASE protocol WHEN 's7comm' THEN 1 WHEN 'xgt_fen' THEN 3 WHEN 'modbus' THEN 4 WHEN 'arp' THEN 5 WHEN 'dns' THEN 8 END AS DOUBLE) AS protocol,
 {sql_r6("coalesce(TRY_CAST(nullif(delta_t, '') AS DOUBLE), -1.0)")} AS delta_t,
 CASE WHEN "match" IN ('O', 'true') THEN 1.0 WHEN "match" = 'X' THEN 0.0 ELSE -1.0 END::DOUBLE AS "match",
 {', '.join(f'{sql_r6(_SERVE_SQL[f])} AS {f}' for f in BASE_FEATURES)}
{_FEATURE_FROM} LEFT JOIN vars vv ON vv.name = nullif(xgt_fen_vars, '')"""


@query("feature_rows", _FEATURE_SQL)
def feature_rows(spark, sf):
    """Every serving feature of every packet under freshly fitted parameters."""
    p, fitted = _fitted(spark, sf)
    return round_doubles(X.featurise(p, fitted, ["seq"], with_slots=False))


_FIT_FEATURES = {f: f"CASE WHEN f_{f} IS NULL THEN -1.0 WHEN flo_{f} = fhi_{f} THEN 0.0 ELSE (f_{f} - flo_{f}) / (fhi_{f} - flo_{f}) END" for f in _RAW_FIT} | {
    "dir_code": "CASE dir WHEN 'request' THEN 1.0 WHEN 'response' THEN 0.0 ELSE -1.0 END",
    "protocol": "CAST(CASE protocol WHEN 's7comm' THEN 0 WHEN 'xgt_fen' THEN 2 WHEN 'modbus' THEN 3 WHEN 'arp' THEN 4 WHEN 'dns' THEN 6 END AS DOUBLE)",
    "protocol_norm": "(CASE protocol WHEN 's7comm' THEN 0 WHEN 'xgt_fen' THEN 2 WHEN 'modbus' THEN 3 WHEN 'arp' THEN 4 WHEN 'dns' THEN 6 END) / 6.0",
    "s7comm_fn": _mine("s7comm", "CAST(s7comm_fn AS BIGINT)"),
    "xgt_err_flag": _mine("xgt_fen", "CASE WHEN CAST(xgt_fen_errstat AS BIGINT) <> 0 THEN 1.0 ELSE 0.0 END"),
    "modbus_regs_count": _mine("modbus", "len(fit_addrs)"), "modbus_regs_addr_min": _mine("modbus", "list_min(fit_addrs)"),
    "modbus_regs_addr_max": _mine("modbus", "list_max(fit_addrs)"), "modbus_regs_addr_range": _mine("modbus", "list_max(fit_addrs) - list_min(fit_addrs)"),
    "modbus_regs_val_min": _mine("modbus", "list_min(vals)"), "modbus_regs_val_max": _mine("modbus", "list_max(vals)"),
    "modbus_regs_val_mean": _mine("modbus", "list_avg(vals)"), "modbus_regs_val_std": _mine("modbus", "list_stddev_pop(vals)"),
    "xgt_addr_count": _mine("xgt_fen", "len(xa)"), "xgt_addr_min": _mine("xgt_fen", "list_min(xa)"), "xgt_addr_max": _mine("xgt_fen", "list_max(xa)"),
    "xgt_addr_range": _mine("xgt_fen", "list_max(xa) - list_min(xa)"), "xgt_word_min": _mine("xgt_fen", "list_min(xw)"),
    "xgt_word_max": _mine("xgt_fen", "list_max(xw)"), "xgt_word_mean": _mine("xgt_fen", "list_avg(xw)"), "xgt_word_std": _mine("xgt_fen", "list_stddev_pop(xw)"),
    "src_host_id": "CAST(coalesce(hs.id, -1) AS DOUBLE)", "dst_host_id": "CAST(coalesce(hd.id, -1) AS DOUBLE)",
    "arp_src_host_id": "CASE WHEN protocol = 'arp' THEN CAST(coalesce(as_.id, -1) AS DOUBLE) ELSE -1.0 END",
    "arp_tgt_host_id": "CASE WHEN protocol = 'arp' THEN CAST(coalesce(at_.id, -1) AS DOUBLE) ELSE -1.0 END",
    "xgt_var_id": "CASE WHEN protocol = 'xgt_fen' THEN CAST(coalesce(vv.id, 0) AS DOUBLE) ELSE 0.0 END",
}


@query("feature_rows_fit", f"""WITH {_PARSED}, {_HOSTS}, {_ARPS}, {_VARS},
lists AS (SELECT seq AS lseq, list_transform(CAST(xgt_fen_translated_addr AS JSON)::VARCHAR[], lambda s: CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)) AS xa,
 CAST(xgt_fen_word_value AS JSON)::DOUBLE[] AS xw FROM pkt)
SELECT seq, {', '.join(f'{sql_r6(e)} AS {f}' for f, e in _FIT_FEATURES.items())}
{_FEATURE_FROM} LEFT JOIN vars vv ON vv.name = {_FIRST_VAR} JOIN lists ON lseq = seq""")
def feature_rows_fit(spark, sf):
    """The fit-time feature variant of every packet."""
    p, fitted = _fitted(spark, sf)
    return round_doubles(X.featurise_fit(p, fitted, ["seq"]))


@query("slot_pairs_first_wins", f"""WITH {pkt_sql('seq', 'protocol', 'modbus_translated_addr', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'k')}, {_SLOTS},
won AS (SELECT seq, proto, p[1] AS addr, first(p[2]) AS v FROM pairs GROUP BY ALL)
SELECT seq, proto, addr, slot, {sql_r6('CASE WHEN v < vmin OR v > vmax THEN -2.0 WHEN vmin = vmax THEN 0.0 ELSE (v - vmin) / (vmax - vmin + 1e-9) END')} AS value
FROM won JOIN slots USING (proto, addr)""")
def slot_pairs_first_wins(spark, sf):
    """Scaled slot values in long form."""
    p = packets(spark, sf, "seq", "protocol", "modbus_translated_addr", "modbus_regs_addr", "modbus_regs_val",
                "xgt_fen_translated_addr", "xgt_fen_word_value", "k")
    slots = FT.number_slots(FT.slot_ranges(p, X.SLOT_FIT_COLUMNS))
    none = None
    fitted = FT.Fitted(none, none, none, none, slots)
    return round_doubles(X.slot_values(p, fitted, "seq"))


_SLOT_NAMES = {"modbus": [str(i) for i in range(12) if i % 3 < 2], "xgt_fen": [f"D{i}" for i in range(12)]}


def _sql_slot(proto: str, prefix: str, a: str) -> str:
    addr, val = (("coalesce(modbus_translated_addr, modbus_regs_addr)", "modbus_regs_val") if proto == "modbus"
                 else ("xgt_fen_translated_addr", "xgt_fen_word_value"))
    v = f"(CAST({val} AS JSON)::DOUBLE[])[list_position(CAST({addr} AS JSON)::VARCHAR[], '{a}')]"
    lo, hi = (f"(SELECT {x} FROM slots WHERE proto = '{proto}' AND addr = '{a}')" for x in ("vmin", "vmax"))
    e = f"CASE WHEN protocol <> '{proto}' OR {v} IS NULL THEN -1.0 WHEN {v} < {lo} OR {v} > {hi} THEN -2.0 WHEN {lo} = {hi} THEN 0.0 ELSE ({v} - {lo}) / ({hi} - {lo} + 1e-9) END"
    return f"{sql_r6(e)} AS {prefix}_slot_{a}_norm"


@query("slot_pivot", f"""WITH {pkt_sql('seq', 'protocol', 'modbus_translated_addr', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'k')}, {_SLOTS}
SELECT seq, {', '.join(_sql_slot(p, 'modbus' if p == 'modbus' else 'xgt', a) for p in _SLOT_NAMES for a in _SLOT_NAMES[p])} FROM pkt""")
def slot_pivot(spark, sf):
    """Slot values as columns."""
    p = packets(spark, sf, "seq", "protocol", "modbus_translated_addr", "modbus_regs_addr", "modbus_regs_val",
                "xgt_fen_translated_addr", "xgt_fen_word_value", "k")
    slots = FT.number_slots(FT.slot_ranges(p, X.SLOT_FIT_COLUMNS))
    values = X.slot_features(p, slots, ["seq"])
    names = [f"{X.SLOT_PREFIX[q]}_slot_{a}_norm" for q, names in _SLOT_NAMES.items() for a in names]
    return round_doubles(values.select("seq", *[e.alias(n) for n, e in X.slot_columns(F.col("slots"), names).items()]))


@query("feature_rows_slots", f"""WITH {pkt_sql('seq', 'protocol', 'sip', 'smac', 'modbus_translated_addr', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'k')}, {_SLOTS},
entry_list AS (SELECT seq, protocol, CASE protocol WHEN 'modbus' THEN CAST(coalesce(modbus_translated_addr, modbus_regs_addr) AS JSON)::VARCHAR[] WHEN 'xgt_fen' THEN CAST(xgt_fen_translated_addr AS JSON)::VARCHAR[] END AS a,
 CASE protocol WHEN 'modbus' THEN CAST(modbus_regs_val AS JSON)::DOUBLE[] WHEN 'xgt_fen' THEN CAST(xgt_fen_word_value AS JSON)::DOUBLE[] END AS v FROM pkt),
each AS (SELECT seq, protocol, unnest(a) AS addr, generate_subscripts(a, 1) AS place FROM entry_list),
won AS (SELECT e.seq, e.protocol, e.addr, arg_min(l.v[e.place], e.place) AS v FROM each e JOIN entry_list l USING (seq) WHERE e.place <= len(l.v) GROUP BY ALL),
own AS (SELECT seq, CASE proto WHEN 'modbus' THEN 'modbus' ELSE 'xgt' END || '_slot_' || won.addr || '_norm' AS name,
 {sql_r6('CASE WHEN v < vmin OR v > vmax THEN -2.0 WHEN vmin = vmax THEN 0.0 ELSE (v - vmin) / (vmax - vmin + 1e-9) END')} AS value FROM won JOIN slots ON proto = protocol AND slots.addr = won.addr)
SELECT seq, CAST(count(*) OVER (PARTITION BY seq) - CASE WHEN name IS NULL THEN 1 ELSE 0 END AS INT) AS n_slots, name, value FROM pkt LEFT JOIN own USING (seq)""")
def feature_rows_slots(spark, sf):
    """All slot features of every feature row, sparse, whatever their number."""
    p, fitted = _fitted(spark, sf)
    rows = X.featurise(p, fitted, ["seq"])
    flat = rows.select("seq", F.size("slots").alias("n_slots"), F.explode_outer("slots").alias("s"))
    return round_doubles(flat.select("seq", "n_slots", F.col("s.name").alias("name"), F.col("s.value").alias("value")))


@query("slot_names", """SELECT DISTINCT '%' || l_shipdate::DATE || ' ' || (l_partkey % 20) AS addr,
 'xgt_slot_' || replace(l_shipdate::DATE::VARCHAR, '-', '_') || (l_partkey % 20) || '_norm' AS feature FROM lineitem""")
def slot_names(spark, sf):
    """Sanitised feature names of address slots."""
    li = table(spark, sf, "lineitem")
    a = F.concat(F.lit("%"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" "), (F.col("l_partkey") % 20).cast("string"))
    return li.select(a.alias("addr")).distinct().select("addr", S.slot_column_expr(F.col("addr"), "xgt").alias("feature"))


@query("slot_pairs_fit", f"""WITH {pkt_sql('seq', 'protocol', 'modbus_translated_addr', 'modbus_regs_addr', 'modbus_regs_val', 'xgt_fen_translated_addr', 'xgt_fen_word_value', 'k')}, {_SLOTS},
won AS (SELECT seq, proto, p[1] AS addr, last(p[2]) AS v FROM pairs GROUP BY ALL)
SELECT seq, proto, addr, slot, {sql_r6('CASE WHEN vmin = vmax THEN 0.0 ELSE (v - vmin) / (vmax - vmin) END')} AS value FROM won JOIN slots USING (proto, addr)""")
def slot_pairs_fit(spark, sf):
    """Slot values as the fit-time matrix has them: the last pair wins, scaling is unchecked."""
    p = packets(spark, sf, "seq", "protocol", "modbus_translated_addr", "modbus_regs_addr", "modbus_regs_val",
                "xgt_fen_translated_addr", "xgt_fen_word_value", "k")
    slots = FT.number_slots(FT.slot_ranges(p, X.SLOT_FIT_COLUMNS))
    return round_doubles(X.slot_values(p, FT.Fitted(None, None, None, None, slots), "seq", last=True))
