"""Binding of the operators to the driver tables: packet view, registry, SQL helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtap.operators.order import Track, track_for
from railtap.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the statement that must give the same rows."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Column definitions of the packet view, valid in Spark and DuckDB once {T} (text
# type) is filled in; k is the number inside props.
_S = "CAST({} AS {{T}})".format
PACKET_VIEW = {
    "seq": "event_id",
    "capture": "CAST(user_id % 4 AS INT)",
    "k": "k",
    "user_id": "user_id",
    "value": "value",
    "ts_us": "ts_us",
    "protocol": "CASE event_type WHEN 'click' THEN 'modbus' WHEN 'view' THEN 'xgt_fen' WHEN 'purchase' THEN 's7comm'"
                " WHEN 'signup' THEN 'dns' ELSE 'arp' END",
    "timestamp": "ts_text",
    "dir": "CASE WHEN event_id % 3 = 0 THEN 'request' WHEN event_id % 3 = 1 THEN 'response' ELSE 'unknown' END",
    "sip": f"concat('10.0.', {_S('user_id % 7')}, '.', {_S('user_id')})",
    "smac": f"concat('02:00:', {_S('user_id % 7')})",
    "dip": f"CASE WHEN k % 29 = 0 THEN '' ELSE concat('10.1.0.', {_S('k')}) END",
    "dmac": f"concat('02:01:', {_S('k % 9')})",
    "sp": _S("1024 + k"),
    "dp": "CASE WHEN k % 2 = 0 THEN '502' ELSE '2004' END",
    "len": _S("CAST(floor(value) AS INT)"),
    "sq": _S("k"),
    "ak": _S("k % 5"),
    "fl": _S("k % 3"),
    "delta_t": f"CASE WHEN k % 6 = 0 THEN '' ELSE {_S('k / 8.0e0')} END",
    "match": "CASE k % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'X' WHEN 2 THEN 'true' WHEN 3 THEN '?' END",
    "src_asset": "CASE user_id % 5 WHEN 0 THEN 'HMI-1' WHEN 1 THEN 'Eng-Station' WHEN 2 THEN 'core switch' END",
    "dst_asset": "CASE k % 6 WHEN 0 THEN 'PLC-7' WHEN 1 THEN 'historian' WHEN 2 THEN 'file server'"
                 " WHEN 3 THEN 'RTU-1' WHEN 4 THEN 'printer' END",
    "modbus_tid": _S("k * 3"),
    "modbus_fc": f"CASE WHEN k % 10 = 0 THEN '6' ELSE {_S('k % 7')} END",
    "modbus_addr": _S("k * 2"),
    "modbus_qty": _S("k % 13"),
    "modbus_bc": f"CASE WHEN k % 13 = 0 THEN '' ELSE {_S('(k % 13) * 2')} END",
    "modbus_regs_addr": f"concat('[', {_S('k')}, ',', {_S('k + 1')}, ',', {_S('k + 2')}, ']')",
    "modbus_regs_val": f"concat('[', {_S('CAST(floor(value) AS INT)')}, ',', {_S('CAST(floor(value * 2) AS INT)')}, ',7]')",
    "modbus_translated_addr": f"CASE WHEN k % 3 = 0 THEN concat('[', {_S('k % 12')}, ',', {_S('(k + 1) % 12')}, ']') END",
    "modbus_regs_translated_addr": f"concat('[', {_S('40000 + k')}, ',', {_S('40001 + k')}, ']')",
    "s7comm_ros": _S("k % 4"),
    "s7comm_fn": f"concat('0x0', {_S('k % 6')})",
    "s7comm_ic": _S("k % 3"),
    "s7comm_db": _S("k"),
    "s7comm_addr": _S("k * 3"),
    "xgt_fen_source": "CASE WHEN k % 2 = 0 THEN '0x33' ELSE '0x11' END",
    "xgt_fen_len": _S("20 + k"),
    "xgt_fen_fenetpos": f"concat('0x', {_S('k % 8')}, {_S('k % 10')})",
    "xgt_fen_cmd": f"concat('0x', {_S('50 + k % 10')})",
    "xgt_fen_dtype": "CASE WHEN k % 3 = 0 THEN '0x14' ELSE '0x02' END",
    "xgt_fen_blkcnt": _S("1 + k % 3"),
    "xgt_fen_errstat": "CASE WHEN k % 13 = 0 THEN '0x0001' ELSE '0x0000' END",
    "xgt_fen_errinfo": _S("k % 2"),
    "xgt_fen_datasize": _S("k"),
    "xgt_fen_vars": f"CASE WHEN k % 4 = 0 THEN '%DB001046' WHEN k % 4 = 1 THEN concat('%DB', {_S('k')}, ',%MW1')"
                    f" WHEN k % 4 = 2 THEN '' ELSE concat('%MW', {_S('k')}) END",
    "xgt_fen_data": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 17 = 0 THEN '0000 0000 0000' WHEN k % 19 = 0 THEN '05001'"
                    " WHEN k % 23 = 0 THEN 'zz' ELSE concat(CASE WHEN k % 8 = 0 THEN '0400' ELSE '0500' END, ' 00',"
                    f" {_S('10 + k % 90')}, ' 0000 ', {_S('1000 + k')}, ' ', CASE WHEN k % 6 = 0 THEN '0000' ELSE"
                    " '0A0B' END, ' ', CASE WHEN k % 5 = 0 THEN '0000' ELSE '1234' END) END",
    "xgt_fen_translated_addr": f"concat('[\"D', {_S('k % 12')}, '\",\"D', {_S('(k + 5) % 12')}, '\"]')",
    "xgt_fen_word_value": f"concat('[', {_S('k')}, ',', {_S('CAST(floor(value) AS INT)')}, ']')",
    "xgt_fen_word_offset": f"concat('[', {_S('k % 12')}, ']')",
    "arp_smac": f"concat('02:00:', {_S('user_id % 7')})",
    "arp_sip": f"concat('10.0.', {_S('user_id % 7')}, '.', {_S('user_id')})",
    "arp_tmac": f"concat('02:01:', {_S('k % 9')})",
    "arp_tip": f"concat('10.1.0.', {_S('k')})",
    "arp_op": _S("1 + k % 2"),
    "dns_tid": f"concat('0x0', {_S('k')})",
    "dns_fl": "CASE WHEN k % 2 = 0 THEN '0x0100' ELSE '0x8180' END",
    "dns_qc": _S("k % 4"),
    "dns_ac": _S("k % 3"),
}


def packets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The packet view over ``events``; naming the columns keeps the scan narrow."""
    ev = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = ev.select("event_id", "user_id", "event_type", "value",
                   F.get_json_object("props", "$.k").cast("int").alias("k"), micros.alias("ts_us"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_text"))
    names = columns or tuple(PACKET_VIEW)
    return ev.selectExpr(*[f"{PACKET_VIEW[n].replace('{T}', 'STRING')} AS `{n}`" for n in names])


def pkt_sql(*columns: str) -> str:
    """The packet view as a DuckDB common table expression named ``pkt``."""
    names = columns or tuple(PACKET_VIEW)
    cols = ",\n  ".join(f'{PACKET_VIEW[n].replace("{T}", "VARCHAR")} AS "{n}"' for n in names)
    return f"""pkt AS (SELECT
  {cols}
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS ts_us,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text FROM events))"""


def event_track(df: DataFrame, by="capture") -> Track:
    return track_for(df, by, "seq")


def r6(c) -> F.Column:
    """Six decimals, half up on the binary value, as :func:`sql_r6` says it in SQL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6


def sql_r6(e: str) -> str:
    return f"(floor(({e}) * 1e6 + 0.5) / 1e6)"


def round_doubles(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])
