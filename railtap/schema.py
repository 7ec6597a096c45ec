"""Packet schema, sentinels and feature names.

Packets are flat rows.  Protocol sub-fields carry their protocol as a prefix
(``modbus_fc``); every loosely typed field is a STRING at the scan and is
coerced by :mod:`railtap.functions.coerce` where it is used.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Sentinels every consumer of the features depends on.
MISSING = -1.0          # feature not applicable to the packet, also padding
OUT_OF_RANGE = -2.0     # value outside the fitted [min, max]; "missing" cell for the reconstructor
NORM_EPS = 1e-9
NO_THRESHOLD = -1       # prediction when no threshold is known

# Protocol codes of the serving features (unknown text -> 0).
PROTOCOL_CODES = {
    "s7comm": 1, "tcp": 2, "xgt_fen": 3, "modbus": 4,
    "arp": 5, "udp": 6, "unknown": 7, "dns": 8,
}
# Protocol codes of the fit-time features (unknown text -> -1).
PROTOCOL_CODES_FIT = {
    "s7comm": 0, "tcp": 1, "xgt_fen": 2, "modbus": 3, "arp": 4, "udp": 5, "dns": 6,
}

MERGE_PROTOCOLS = ("modbus", "xgt_fen")

# Packet fields by protocol, as capture files name them.
PACKET_FIELDS = {
    "": ["timestamp", "protocol", "smac", "dmac", "sip", "dip", "sp", "dp", "len", "dir",
         "sq", "ak", "fl", "delta_t", "match", "src_asset", "dst_asset",
         "transaction_id", "trans_id", "tid"],
    "modbus": ["tid", "sq", "transaction_id", "fc", "addr", "qty", "bc", "regs_addr", "regs_val",
               "translated_addr", "regs_translated_addr", "word_value"],
    "s7comm": ["ros", "fn", "ic", "db", "addr"],
    "xgt_fen": ["sq", "invoke_id", "source", "len", "fenetpos", "cmd", "dtype", "blkcnt",
                "errstat", "errinfo", "datasize", "vars", "data", "translated_addr",
                "word_value", "word_offset"],
    "arp": ["smac", "tmac", "sip", "tip", "op"],
    "dns": ["tid", "fl", "qc", "ac"],
}


def packet_columns() -> list[str]:
    """Flat packet column names in declaration order."""
    return [f"{p}_{f}" if p else f for p, fields in PACKET_FIELDS.items() for f in fields]


def raw_field_names() -> dict[str, str]:
    """Dotted name in the capture file -> flat column name."""
    # register lists sit one level deeper in the capture files (modbus.regs.addr)
    nested = {"regs_addr": "regs.addr", "regs_val": "regs.val",
              "regs_translated_addr": "regs.translated_addr"}
    out = {}
    for proto, fields in PACKET_FIELDS.items():
        for f in fields:
            out[f"{proto}.{nested.get(f, f)}" if proto else f] = f"{proto}_{f}" if proto else f
    return out


def packet_scan_schema() -> T.StructType:
    """All-STRING schema of a capture file; ``@timestamp`` and dotted names as written there."""
    names = ["@timestamp", *raw_field_names()]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Serving feature columns, in catalog order.
COMMON_FEATURES = ["src_host_id", "dst_host_id", "sp_norm", "dp_norm", "dir_code", "len_norm"]
S7COMM_FEATURES = ["s7comm_ros_norm", "s7comm_fn", "s7comm_db_norm", "s7comm_addr_norm"]
MODBUS_FEATURES = [
    "modbus_addr_norm", "modbus_fc_norm", "modbus_qty_norm", "modbus_bc_norm",
    "modbus_regs_count", "modbus_regs_addr_min", "modbus_regs_addr_max", "modbus_regs_addr_range",
    "modbus_regs_val_min", "modbus_regs_val_max", "modbus_regs_val_mean", "modbus_regs_val_std",
]
XGT_FEATURES = [
    "xgt_var_id", "xgt_var_cnt", "xgt_source", "xgt_fenet_base", "xgt_fenet_slot", "xgt_cmd",
    "xgt_dtype", "xgt_blkcnt", "xgt_err_flag", "xgt_err_code", "xgt_datasize", "xgt_data_missing",
    "xgt_data_len_chars", "xgt_data_num_spaces", "xgt_data_is_hex", "xgt_data_n_bytes",
    "xgt_data_zero_ratio", "xgt_data_first_byte", "xgt_data_last_byte", "xgt_data_mean_byte",
    "xgt_data_bucket",
]
ARP_FEATURES = ["arp_src_host_id", "arp_tgt_host_id", "arp_op_num"]
DNS_FEATURES = ["dns_qc_norm", "dns_ac_norm"]
BASE_FEATURES = ["protocol_norm", *COMMON_FEATURES, *S7COMM_FEATURES, *MODBUS_FEATURES,
                 *XGT_FEATURES, *ARP_FEATURES, *DNS_FEATURES]
