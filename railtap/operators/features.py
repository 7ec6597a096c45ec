"""Packets to feature rows.

Every feature is a Column expression that applies to its own protocol and is -1
for the others, so featurising is one projection.  Only host and variable ids
need a join, and all of them the same one; the fitted ranges are a fixed, small
set of numbers and enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions import scalars as S
from railtap.operators.fit import (Fitted, entry, host_token, number_by_first_use, number_by_kind, number_slots, ranges,
                                   slot_entries, token_table)
from railtap.operators.order import hot_keys
from railtap.schema import (ARP_FEATURES, BASE_FEATURES, COMMON_FEATURES, DNS_FEATURES, MISSING, MODBUS_FEATURES,
                            S7COMM_FEATURES, XGT_FEATURES)
from railtap.session import block_count, checkpoint

SLOT_PREFIX = {"modbus": "modbus", "xgt_fen": "xgt"}
SLOT_FIT_COLUMNS = {"modbus": ("modbus_translated_addr", "modbus_regs_val"),
                    "xgt_fen": ("xgt_fen_translated_addr", "xgt_fen_word_value")}


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _of(protocol: str, value: Column) -> Column:
    return F.when(F.col("protocol") == protocol, value)


def with_parsed(df: DataFrame) -> DataFrame:
    """Add the parsed lists several features read, each only for its own protocol."""
    c = lambda n: _col(df, n)
    addresses = F.coalesce(c("modbus_translated_addr"), c("modbus_regs_addr"))
    return (df.withColumn("_addrs", _of("modbus", C.int_list(addresses)))
            .withColumn("_vals", _of("modbus", C.int_list(c("modbus_regs_val"))))
            .withColumn("_bytes", _of("xgt_fen", S.payload_bytes(c("xgt_fen_data")))))


def _sketched(df: DataFrame, part: str, stats: dict[str, Column]) -> dict[str, Column]:
    """The same figures from the group sketch of a merged packet, where it has one (see ``merge.group_sketch``)."""
    if "sketch" not in df.columns:
        return stats
    known = df.schema["sketch"].dataType[part].dataType.names
    s = F.col("sketch")[part]
    return {k: F.when(s.isNotNull(), s[k]).otherwise(e) if k in known else e for k, e in stats.items()}


def raw_values(df: DataFrame) -> dict[str, Column]:
    """Unscaled value of every range-scaled serving feature, null outside its protocol."""
    c = lambda n: _col(df, n)
    i = lambda n: C.safe_int(c(n)).cast("double")
    out = {"sp_norm": i("sp"), "dp_norm": i("dp"), "len_norm": i("len")}
    for f, n in (("s7comm_ros_norm", "s7comm_ros"), ("s7comm_db_norm", "s7comm_db"), ("s7comm_addr_norm", "s7comm_addr")):
        out[f] = _of("s7comm", i(n))
    for f in ("addr", "fc", "qty", "bc"):
        out[f"modbus_{f}_norm"] = _of("modbus", i(f"modbus_{f}"))
    a = _sketched(df, "addrs", S.range_stats(F.col("_addrs")))
    v = _sketched(df, "vals", S.moment_stats(F.col("_vals")))
    out["modbus_regs_count"] = _of("modbus", a["count"])
    for k in ("min", "max", "range"):
        out[f"modbus_regs_addr_{k}"] = _of("modbus", a[k])
    for k in ("min", "max", "mean", "std"):
        out[f"modbus_regs_val_{k}"] = _of("modbus", v[k])
    pos = C.safe_int(c("xgt_fen_fenetpos"))
    data = _sketched(df, "data", S.payload_stats(c("xgt_fen_data"), F.col("_bytes")))
    xgt = {"var_cnt": F.when(F.coalesce(c("xgt_fen_vars"), F.lit("")) != "", 1.0).otherwise(0.0),
           "source": i("xgt_fen_source"), "fenet_base": S.high_nibble(pos).cast("double"),
           "fenet_slot": S.low_nibble(pos).cast("double"), "cmd": i("xgt_fen_cmd"), "dtype": i("xgt_fen_dtype"),
           "blkcnt": i("xgt_fen_blkcnt"), "err_code": i("xgt_fen_errinfo"), "datasize": i("xgt_fen_datasize"),
           "data_len_chars": data["len_chars"], "data_num_spaces": data["num_spaces"], "data_n_bytes": data["n_bytes"]}
    out |= {f"xgt_{k}": _of("xgt_fen", e) for k, e in xgt.items()}
    out |= {f"dns_{k}_norm": _of("dns", i(f"dns_{k}")) for k in ("qc", "ac")}
    return out


def raw_values_fit(df: DataFrame) -> dict[str, Column]:
    """Unscaled value of every range-scaled fit-time feature (null when missing), named ``fit_<feature>``."""
    c = lambda n: _col(df, n)
    d = lambda n: C.py_float(c(n))
    h = lambda n: C.hex_or_decimal_float(c(n))
    out = {f"{k}_norm": d(k) for k in ("sp", "dp", "len")}
    out |= {f"s7comm_{k}_norm": (h if k == "fn" else d)(f"s7comm_{k}") for k in ("ros", "fn", "ic", "db", "addr")}
    out |= {f"modbus_{k}_norm": d(f"modbus_{k}") for k in ("tid", "fc", "addr", "qty", "bc")}
    pos = C.hex_or_decimal_int(c("xgt_fen_fenetpos"))
    names = F.size(C.name_list(c("xgt_fen_vars")))
    out |= {"xgt_var_cnt_norm": F.when(names > 0, names.cast("double")),
            "xgt_fenet_base_norm": S.high_nibble(pos, masked=True).cast("double"),
            "xgt_fenet_slot_norm": S.low_nibble(pos).cast("double"), "xgt_err_code_norm": h("xgt_fen_errstat")}
    out |= {f"xgt_{k}_norm": h(f"xgt_fen_{k}") for k in ("source", "len", "cmd", "dtype", "blkcnt", "datasize")}
    out |= {"arp_op_num": d("arp_op"), "dns_tid_norm": h("dns_tid"), "dns_fl_norm": h("dns_fl"),
            "dns_qc_norm": d("dns_qc"), "dns_ac_norm": d("dns_ac")}
    owner = {k: next((p for p in ("s7comm", "modbus", "xgt", "arp", "dns") if k.startswith(p)), None) for k in out}
    return {f"fit_{k}": e if owner[k] is None else _of("xgt_fen" if owner[k] == "xgt" else owner[k], e)
            for k, e in out.items()}


def fit(df: DataFrame, order: str = "seq", missing_as_zero: bool = True,
        arp_source: tuple[str, str] = ("sip", "smac"), slot_columns=None) -> Fitted:
    """Fit every range and vocabulary from raw packets in two scans: one for the ranges, one for all tokens."""
    p = with_parsed(df)
    values = raw_values(p) | raw_values_fit(p)
    c = lambda n: _col(df, n)
    src = host_token(c("sip"), c("smac"))
    pairs = slot_entries({q: av for q, av in (slot_columns or SLOT_FIT_COLUMNS).items() if set(av) <= set(df.columns)})
    slots = F.transform(pairs, lambda x: F.struct(F.concat(F.lit("slot:"), F.col("protocol")).alias("kind"),
                                                  x["k"].alias("token"), x["v"].alias("v")))
    entries = F.concat(F.array(
        entry("host", src), entry("host", host_token(c("dip"), c("dmac"))),
        entry("arp", _of("arp", host_token(c(arp_source[0]), c(arp_source[1])))),
        entry("arp", _of("arp", host_token(c("arp_tip"), c("arp_tmac")))),
        entry("var", _of("xgt_fen", F.get(C.name_list(c("xgt_fen_vars")), 0)))), slots)
    t = token_table(df, entries, order)
    of = lambda kind, name: t.where(F.col("kind") == kind).select(F.col("token").alias(name), "at")
    slot_rows = t.where(F.col("kind").startswith("slot:")).select(
        F.substring("kind", 6, 64).alias("proto"), F.col("token").alias("addr"), "vmin", "vmax")
    by_text = number_by_kind(t.where(F.col("kind").isin("host", "arp")), "kind", "token")
    numbered = lambda kind: by_text.where(F.col("kind") == kind).select("token", "id")
    return Fitted(host_vocab=numbered("host"), arp_vocab=numbered("arp"),
                  var_vocab=number_by_first_use(of("var", "name"), "name"),
                  norm_params=ranges(p, values, missing_as_zero), slot_params=number_slots(slot_rows))


def range_literals(norm_params: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Fitted ranges as literals; the table has one row per known feature."""
    got = {r["feature"]: (F.lit(r["vmin"]), F.lit(r["vmax"])) for r in norm_params.collect()}
    none = F.lit(None).cast("double")
    return _Default(got, (none, none))


class _Default(dict):
    def __init__(self, items, default):
        super().__init__(items)
        self._default = default

    def __missing__(self, key):
        return self._default


def id_table(fitted: Fitted) -> DataFrame:
    """Every fitted token in one table: ``kind, token, id`` and, for address slots, feature name and range."""
    def part(df: DataFrame, kind: Column, token: str, ident: str, *more: Column) -> DataFrame:
        none = [F.lit(None).cast("string").alias("feature"), *[F.lit(None).cast("double").alias(c) for c in ("vmin", "vmax")]]
        return df.select(kind.alias("kind"), F.col(token).alias("token"), F.col(ident).cast("double").alias("id"), *(more or none))

    prefix = F.create_map(*[F.lit(x) for kv in SLOT_PREFIX.items() for x in kv])
    table = part(fitted.host_vocab, F.lit("host"), "token", "id")
    table = table.unionByName(part(fitted.arp_vocab, F.lit("arp"), "token", "id"))
    table = table.unionByName(part(fitted.var_vocab, F.lit("var"), "name", "id"))
    if fitted.slot_params is not None:
        name = F.concat(F.try_element_at(prefix, F.col("proto")), S.slot_column_expr(F.col("addr"), ""))
        table = table.unionByName(part(fitted.slot_params, F.concat(F.lit("slot:"), F.col("proto")), "addr", "slot",
                                       name.alias("feature"), F.col("vmin"), F.col("vmax")))
    return table


def encode(rows: DataFrame, fitted: Fitted, ids: dict[str, tuple[str, Column, float]], slots: Column | None = None) -> DataFrame:
    """Add the ids of several token columns and, sparsely, the scaled slot values of every row.

    ``ids`` maps a name to (vocabulary, token, id of an unknown token); ``slots``
    is an array of ``struct<kind,token,v>``.  All tokens of a row travel as a long
    narrow table, meet one vocabulary table in one join and are folded back by
    row, so the wide rows move once.  Tokens that hold a large share of the rows
    are salted; any choice of them gives the same result.
    """
    spark = rows.sparkSession
    none = F.lit(None).cast("double")
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), token.alias("token"), none.alias("v"))
                        for name, (kind, token, _) in ids.items()])
    if slots is not None:
        entries = F.concat(entries, F.transform(F.coalesce(slots, F.array().cast("array<struct<kind:string,token:string,v:double>>")), lambda x: F.struct(
            x["kind"].alias("kind"), F.lit("").alias("name"), x["token"].alias("token"), x["v"].alias("v"))))
    wide = rows.withColumns({"_rid": F.monotonically_increasing_id(), "_tokens": F.filter(entries, lambda e: e["token"].isNotNull())})
    wide = checkpoint(spark, wide, "features")   # row ids stay as they are, and what follows reads tokens alone
    long = wide.select("_rid", F.inline("_tokens"))
    hot, salts = hot_keys(long, ["kind", "token"]), 4 * block_count(spark)
    is_hot = F.xxhash64("kind", "token").isin(hot) if hot else F.lit(False)
    salted = id_table(fitted).withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    found = long.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("_rid"), F.lit(salts)).cast("int")).otherwise(F.lit(0))) \
        .join(salted, ["kind", "token", "_salt"])
    aggs = [F.max(F.when(F.col("name") == n, F.col("id"))).alias(n) for n in ids]
    if slots is not None:
        value = F.struct(F.col("feature").alias("name"), S.minmax_sentinel(F.col("v"), F.col("vmin"), F.col("vmax")).alias("value"))
        aggs.append(F.array_sort(F.collect_list(F.when(F.col("feature").isNotNull() & F.col("v").isNotNull(), value))).alias("slots"))
    out = wide.drop("_tokens").join(found.groupBy("_rid").agg(*aggs), "_rid", "left").drop("_rid")
    filled = {n: F.coalesce(F.col(n), F.lit(float(unknown))) for n, (_, _, unknown) in ids.items()}
    if slots is not None:
        filled["slots"] = F.coalesce("slots", F.array().cast("array<struct<name:string,value:double>>"))
    return out.withColumns(filled)


def slot_map(df: DataFrame, proto: str) -> Column:
    """Address to value of a packet, first value of an address wins."""
    c = lambda n: _col(df, n)
    if proto == "modbus":
        a1, a2 = C.str_list(c("modbus_translated_addr")), C.str_list(c("modbus_regs_addr"))
        v1, v2 = C.float_list(c("modbus_word_value")), C.float_list(c("modbus_regs_val"))
        keys, vals = F.when(F.size(a1) > 0, a1).otherwise(a2), F.when(F.size(v1) > 0, v1).otherwise(v2)
    else:
        keys, vals = C.str_list(c("xgt_fen_translated_addr")), C.float_list(c("xgt_fen_word_value"))
    own = _of(proto, S.pair_map(S.zip_shortest(keys, vals)))
    return F.when(F.col("raw_count") > 1, F.col("sketch.slots")).otherwise(own) if "sketch" in df.columns else own


def slot_entries_of(df: DataFrame) -> Column:
    """A packet's addresses and values as ``array<struct<kind,token,v>>``, the first value of an address only."""
    out = F.lit(None).cast("array<struct<kind:string,token:string,v:double>>")
    for proto in SLOT_PREFIX:
        own = F.transform(F.map_entries(slot_map(df, proto)), lambda e: F.struct(
            F.lit(f"slot:{proto}").alias("kind"), e["key"].alias("token"), e["value"].alias("v")))
        out = F.coalesce(own, out)
    return out


def slot_features(df: DataFrame, slot_params: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and the sparse ``slots`` of every packet, without the other features."""
    empty = df.sparkSession.createDataFrame([], "token string, name string, id bigint")
    fitted = Fitted(empty, empty, empty, None, slot_params)
    return encode(df.select(*keep, slot_entries_of(df).alias("_in")), fitted, {}, F.col("_in")).drop("_in")


def slot_columns(slots: Column, names: list[str]) -> dict[str, Column]:
    """Chosen slot features as columns, -1 where a row has no value for the address."""
    m = F.map_from_entries(slots)
    return {n: F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(MISSING)) for n in names}


def slot_values(df: DataFrame, fitted: Fitted, ident: str, last: bool = False, columns=None) -> DataFrame:
    """Long form of the slot features: ``(ident, proto, addr, slot, value)`` for known addresses only.

    ``last`` takes the last pair of a repeated address and scales without a
    range check, as the fit-time matrix does.
    """
    pairs = F.array().cast("array<struct<k:string,v:double>>")
    for proto, (a, v) in (columns or SLOT_FIT_COLUMNS).items():
        own = S.zip_shortest(C.str_list(F.col(a)), C.float_list(F.col(v)))
        pairs = F.when(F.col("protocol") == proto, own).otherwise(pairs)
    e = df.select(ident, F.col("protocol").alias("proto"), F.explode(S.pair_map(pairs, last)).alias("addr", "v"))
    scale = S.minmax_plain if last else S.minmax_sentinel
    return e.join(fitted.slot_params, ["proto", "addr"]).select(
        ident, "proto", "addr", "slot", scale(F.col("v"), F.col("vmin"), F.col("vmax")).alias("value"))


def featurise(df: DataFrame, fitted: Fitted, keep: list[str] | None = None, with_slots: bool = True) -> DataFrame:
    """Serving feature rows: kept columns, ``protocol, delta_t, match``, base features.

    ``with_slots`` adds the slot features sparsely: ``slots``, sorted
    ``array<struct<name,value>>`` of the fitted addresses a packet has, however
    many there are; :func:`slot_columns` turns chosen ones into columns.
    """
    keep = keep or []
    p = with_parsed(df)
    raw, lim = raw_values(p), range_literals(fitted.norm_params)
    blank = lambda e: F.when(F.trim(e) == "", None).otherwise(e)
    p = p.withColumns({f"_raw_{f}": e for f, e in raw.items()})
    scaled = {f: S.minmax_sentinel(F.col(f"_raw_{f}"), *lim[f]) for f in raw}
    data = S.payload_stats(_col(df, "xgt_fen_data"), F.col("_bytes"))
    scaled |= {"s7comm_fn": _of("s7comm", C.safe_int(_col(df, "s7comm_fn")).cast("double")),
               "xgt_err_flag": _of("xgt_fen", F.when((C.safe_int(_col(df, "xgt_fen_errstat")) != 0)
                                                     | (C.safe_int(_col(df, "xgt_fen_errinfo")) != 0), 1.0).otherwise(0.0)),
               "arp_op_num": _of("arp", C.safe_int(_col(df, "arp_op")).cast("double"))}
    for k in ("missing", "is_hex", "zero_ratio", "first_byte", "last_byte", "mean_byte", "bucket"):
        scaled[f"xgt_data_{k}"] = _of("xgt_fen", data[k])
    scaled["protocol_norm"] = S.protocol_norm(S.protocol_code(F.col("protocol")))
    scaled["dir_code"] = S.direction_code(_col(df, "dir"))
    owner = ([("s7comm", f) for f in S7COMM_FEATURES] + [("modbus", f) for f in MODBUS_FEATURES]
             + [("xgt_fen", f) for f in XGT_FEATURES] + [("dns", f) for f in DNS_FEATURES]
             + [("arp", f) for f in ARP_FEATURES])
    for proto, f in owner:
        if f in scaled:
            scaled[f] = F.when(F.col("protocol") == proto, scaled[f]).otherwise(F.lit(MISSING))
    ids = {"src_host_id": host_token(F.col("sip"), F.col("smac")), "dst_host_id": host_token(F.col("dip"), F.col("dmac")),
           "arp_src_host_id": _of("arp", host_token(F.col("sip"), F.col("smac"))),
           "arp_tgt_host_id": _of("arp", host_token(_col(df, "arp_tip"), _col(df, "arp_tmac"))),
           "xgt_var_id": _of("xgt_fen", blank(_col(df, "xgt_fen_vars")))}
    # all wide inputs are projected away before the lookup: only features and tokens travel
    rows = p.select(*[F.col(k).alias(f"_keep_{k}") for k in keep],
                    S.protocol_code(F.col("protocol")).cast("double").alias("protocol"), F.col("protocol").alias("_proto"),
                    C.safe_float(_col(df, "delta_t")).alias("delta_t"), C.match_code(_col(df, "match")).alias("match"),
                    *[scaled[f].alias(f) for f in BASE_FEATURES if f in scaled], *[e.alias(f"_tok_{n}") for n, e in ids.items()],
                    *([slot_entries_of(p).alias("_tok_slots")] if with_slots else []))
    kinds = {"src_host_id": "host", "dst_host_id": "host", "arp_src_host_id": "arp", "arp_tgt_host_id": "arp", "xgt_var_id": "var"}
    rows = encode(rows, fitted, {n: (k, F.col(f"_tok_{n}"), 0.0) for n, k in kinds.items()},
                  F.col("_tok_slots") if with_slots else None)
    mine = {"arp_src_host_id": "arp", "arp_tgt_host_id": "arp", "xgt_var_id": "xgt_fen"}
    final = {n: F.when(F.col("_proto") == q, F.col(n)).otherwise(F.lit(MISSING)).alias(n) for n, q in mine.items()}
    return rows.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], "protocol", "delta_t", "match",
                       *[final.get(f, F.col(f)) for f in BASE_FEATURES], *(["slots"] if with_slots else []))


def featurise_fit(df: DataFrame, fitted: Fitted, keep: list[str] | None = None) -> DataFrame:
    """Fit-time feature rows: unchecked scaling, -1 for missing values and unknown hosts."""
    keep = keep or []
    lim = range_literals(fitted.norm_params)
    raw = raw_values_fit(df)
    df = df.withColumns({f"_raw_{k}": e for k, e in raw.items()})
    cols = {k.removeprefix("fit_"): S.minmax_plain(F.col(f"_raw_{k}"), *lim[k]) for k in raw}
    c = lambda n: _col(df, n)
    cols["dir_code"] = S.direction_code(c("dir"), "fit")
    code = S.protocol_code(F.col("protocol"), "fit")
    cols["protocol"], cols["protocol_norm"] = code.cast("double"), S.protocol_norm(code, "fit")
    cols["s7comm_fn"] = F.coalesce(_of("s7comm", C.hex_or_decimal_float(c("s7comm_fn"))), F.lit(MISSING))
    err = C.hex_or_decimal_float(c("xgt_fen_errstat"))
    cols["xgt_err_flag"] = F.coalesce(_of("xgt_fen", F.when(F.coalesce(err, F.lit(0.0)) != 0.0, 1.0).otherwise(0.0)),
                                      F.lit(MISSING))
    df = (df.withColumn("_ma", _of("modbus", C.float_list(c("modbus_regs_addr"))))
          .withColumn("_mv", _of("modbus", C.float_list(c("modbus_regs_val"))))
          .withColumn("_xa", _of("xgt_fen", C.address_numbers(c("xgt_fen_translated_addr"))))
          .withColumn("_xv", _of("xgt_fen", C.hex_word_list(c("xgt_fen_word_value")))))
    listed = {"modbus": (S.range_stats(F.col("_ma"), MISSING), S.moment_stats(F.col("_mv"), MISSING),
                         "modbus_regs", "addr", "val"),
              "xgt_fen": (S.range_stats(F.col("_xa"), MISSING), S.moment_stats(F.col("_xv"), MISSING),
                          "xgt", "addr", "word")}
    for proto, (r, m, prefix, a, v) in listed.items():
        count = f"{prefix}_count" if proto == "modbus" else f"{prefix}_{a}_count"
        cols[count] = F.coalesce(_of(proto, r["count"]), F.lit(MISSING))
        cols |= {f"{prefix}_{a}_{k}": F.coalesce(_of(proto, r[k]), F.lit(MISSING)) for k in ("min", "max", "range")}
        cols |= {f"{prefix}_{v}_{k}": F.coalesce(_of(proto, m[k]), F.lit(MISSING)) for k in ("min", "max", "mean", "std")}
    first_name = _of("xgt_fen", F.get(C.name_list(c("xgt_fen_vars")), 0))
    tokens = {"src_host_id": host_token(c("sip"), c("smac")), "dst_host_id": host_token(c("dip"), c("dmac")),
              "arp_src_host_id": _of("arp", host_token(c("arp_sip"), c("arp_smac"))),
              "arp_tgt_host_id": _of("arp", host_token(c("arp_tip"), c("arp_tmac"))), "xgt_var_id": first_name}
    rows = df.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], *[e.alias(n) for n, e in cols.items()],
                     *[e.alias(f"_tok_{n}") for n, e in tokens.items()])
    kinds = {"src_host_id": ("host", -1.0), "dst_host_id": ("host", -1.0), "arp_src_host_id": ("arp", -1.0),
             "arp_tgt_host_id": ("arp", -1.0), "xgt_var_id": ("var", 0.0)}
    rows = encode(rows, fitted, {n: (kind, F.col(f"_tok_{n}"), unknown) for n, (kind, unknown) in kinds.items()})
    return rows.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], *cols, *tokens)
