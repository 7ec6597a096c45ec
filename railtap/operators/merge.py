"""Joining split packets back together.

Consecutive packets of one capture with equal merge key form a group.  Group
numbers come from block-wise run numbering.  Lists are aggregated by (group,
chunk of ``CHUNK_ROWS`` packets), so that a group of any length never meets in
one task; what holds for the group as a whole comes from rows without lists, one
per chunk, and joins the lists on both keys.  Together the chunk rows hold every
value of the group.  A group of up to ``CHUNK_ROWS`` packets is one row, with
``chunk`` 0.  The features of a merged packet need no lists: they come from
:func:`group_sketch`, which adds up over a group of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions.coerce import iso_epoch_ms
from railtap.functions.scalars import protocol_alias
from railtap.operators.order import Track, islands, with_running_sum
from railtap.schema import MERGE_PROTOCOLS
from railtap.session import checkpoint

# Id fields tried in turn for the online merge key.
ID_FIELDS = ("sq", "modbus_sq", "xgt_fen_sq", "transaction_id", "trans_id", "tid", "modbus_tid",
             "modbus_transaction_id", "xgt_fen_invoke_id")
# Address and value columns joined by the offline merge.
PAIR_COLUMNS = {"modbus": ("modbus_regs_translated_addr", "modbus_regs_val"),
                "xgt_fen": ("xgt_fen_word_offset", "xgt_fen_word_value")}
#: Fields whose lists the features of a merged packet look into.
SKETCHED = ("modbus_translated_addr", "modbus_regs_addr", "modbus_word_value", "modbus_regs_val", "xgt_fen_data",
            "xgt_fen_translated_addr", "xgt_fen_word_value")
DEFAULT_BUCKET_MS = 3
CHUNK_ROWS = 1 << 16


def _mergeable(df: DataFrame, protocols) -> Column:
    wanted = set(protocols) | ({"xgt-fen"} if "xgt_fen" in protocols else set())
    return F.coalesce(F.col("protocol").isin(*sorted(wanted)), F.lit(False))


def online_key(df: DataFrame, protocols=MERGE_PROTOCOLS, bucket_ms: int = DEFAULT_BUCKET_MS,
               ts_ms: str | None = None) -> Column:
    """Serving key: first non-empty id field with the timestamp text, else the time bucket; null = not merged."""
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ID_FIELDS if c in df.columns]
    ident = F.coalesce(*ids) if ids else F.lit(None).cast("string")
    stamp = F.nullif(F.col("timestamp"), F.lit(""))
    ms = F.col(ts_ms) if ts_ms else iso_epoch_ms(F.col("timestamp"))
    by_id = ident.isNotNull() & stamp.isNotNull()
    bucket = F.coalesce(F.floor(ms / max(1, bucket_ms)), F.lit(0)).cast("string")
    return F.when(_mergeable(df, protocols), F.struct(
        protocol_alias(F.col("protocol")).alias("p"), F.when(by_id, stamp).otherwise(bucket).alias("t"),
        F.when(by_id, ident).otherwise(F.lit("bucket")).alias("q")))


def offline_key(df: DataFrame, protocols=MERGE_PROTOCOLS) -> Column:
    """Batch key: protocol, timestamp text and sequence number; null = not merged."""
    return F.when(F.col("protocol").isin(*protocols), F.struct(
        F.col("protocol").alias("p"), F.coalesce("timestamp", F.lit("")).alias("t"), F.col("sq").alias("q")))


def groups(df: DataFrame, t: Track, key: Column, alone: str | None = None) -> DataFrame:
    """Rows with ``merge_event_id`` (from 1 per capture), their place ``idx`` in the group and ``ordinal``.

    ``alone`` names one more column: whether the packet is all of its group.
    """
    out = islands(df, t, key, group="merge_event_id", first="_first", ordinal="ordinal", alone=alone)
    return out.withColumn("idx", F.col("ordinal") - F.col("_first")).drop("_first")


def _prefixed(df: DataFrame, protocols) -> list[str]:
    return [c for c in df.columns if any(c.startswith(p + "_") for p in protocols)]


def _ordered_list(value: Column, order: Column, keep_null: bool) -> Column:
    """Values of a chunk in order."""
    # a null value inside a struct survives collect_list
    item = F.struct(order.alias("i"), value.alias("v"))
    items = F.array_sort(F.collect_list(item if keep_null else F.when(value.isNotNull(), item)))
    return F.transform(items, lambda s: s["v"])


def _chunked(df: DataFrame, chunk_rows: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("idx") / F.lit(chunk_rows)))


def _over_chunks(narrow: DataFrame, by: tuple[str, ...], whole: dict[str, Callable]) -> DataFrame:
    """What holds for a group as a whole, on each of its chunks; rows here hold no lists, one stands for a chunk."""
    w = W.partitionBy(*by, "merge_event_id")
    first = w.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ordered = (F.first, F.last)
    return narrow.withColumns({n: e(n).over(w) if e not in ordered else e(n, ignorenulls=True).over(first) for n, e in whole.items()})


def merge_online(grouped: DataFrame, by, order: str, protocols=MERGE_PROTOCOLS,
                 chunk_rows: int = CHUNK_ROWS, written: bool = False) -> DataFrame:
    """A row per group and chunk: the group's first packet, each protocol field replaced by the group's value.

    A field with one distinct non-null value in the group keeps it; otherwise it
    becomes the JSON list of the chunk's non-null values in order.  ``grouped`` is
    read twice and written first, unless it is ``written`` already.
    """
    fields = _prefixed(grouped, protocols)
    return _merge(grouped, by, order, fields, (), protocols, chunk_rows, keep_null=False, written=written)


def merge_offline(grouped: DataFrame, by, order: str, protocols=MERGE_PROTOCOLS,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Batch merge: the address and value columns are concatenated as text lists, every other protocol
    field is the common value or the full JSON list with nulls; a lone packet is left as it is."""
    pairs = tuple(c for p in protocols for c in PAIR_COLUMNS.get(p, ()) if c in grouped.columns)
    return _merge(grouped, by, order, _prefixed(grouped, protocols), pairs, protocols, chunk_rows, keep_null=True)


def _merge(df, by, order, fields, pairs, protocols, chunk_rows, keep_null, written=False):
    by = (by,) if isinstance(by, str) else tuple(by)
    keys = [*by, "merge_event_id", "chunk"]
    at, i = F.col(order), F.col("idx")
    base = [c for c in df.columns if c not in (*by, "merge_event_id", "idx")]
    rows = _chunked(df if written else checkpoint(df.sparkSession, df, "grouped"), chunk_rows)
    lists, plain = [], [f for f in fields if f not in pairs]
    for f in plain:
        lists.append(_ordered_list(F.col(f), i, keep_null).alias(f"_l_{f}"))
    for f in pairs:
        items = F.when(F.trim(f).rlike(r"(?s)^\[.*\]$"), F.coalesce(
            F.from_json(F.col(f), "array<string>"), F.array(f))).when(F.col(f).isNotNull(), F.array(f))
        lists.append(F.flatten(_ordered_list(items, i, False)).alias(f"_l_{f}"))
    narrow = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*base), at).alias("_base"), F.count(F.lit(1)).alias("raw_count"),
        *[e.alias(f"_{k}_{f}") for f in plain for k, e in (("lo", F.min(f)), ("hi", F.max(f)), ("c", F.count(f)))])
    g = _over_chunks(narrow, by, {"raw_count": F.sum, "_base": F.first} | {
        f"_{k}_{f}": e for f in plain for k, e in (("lo", F.min), ("hi", F.max), ("c", F.sum))})
    if lists:
        # both sides are dealt by group and chunk: the lists stay where they were built
        g = rows.groupBy(*keys).agg(*lists).join(g, keys)
    proto = protocol_alias(F.col("_base.protocol"))

    def merged(f: str) -> Column:
        owner = next(p for p in sorted(protocols, key=len, reverse=True) if f.startswith(p + "_"))
        use = (F.col("raw_count") > 1) & (proto == owner)
        if f in pairs:
            new = F.to_json(f"_l_{f}")
        else:
            lo, hi, c = F.col(f"_lo_{f}"), F.col(f"_hi_{f}"), F.col(f"_c_{f}")
            full = (c == F.col("raw_count")) if keep_null else F.lit(True)
            same = (lo == hi) & full
            # with no value at all the batch merge keeps null and the online one keeps the first packet's, null too
            new = F.when(c == 0, F.lit(None).cast("string")).when(same, lo).otherwise(F.to_json(f"_l_{f}"))
        return F.when(use, new).otherwise(F.col("_base")[f])

    return g.select(*by, "merge_event_id", "chunk", "raw_count",
                    *[(merged(c) if c in fields else F.col("_base")[c]).alias(c) for c in base])


def list_overflow(grouped: DataFrame, by, list_rows: int, protocols=MERGE_PROTOCOLS) -> DataFrame:
    """Values past the first ``list_rows`` of a group in long form, one row per (group, field, place); 0 gives all."""
    by = (by,) if isinstance(by, str) else tuple(by)
    fields = _prefixed(grouped, protocols)
    rest = grouped.where(F.col("idx") >= list_rows).select(*by, "merge_event_id", "idx", *fields)
    return rest.unpivot([*by, "merge_event_id", "idx"], fields, "field", "value")


def group_meta(grouped: DataFrame, by, order: str, ident: str, ts_ms: str, pop_time: str, ingest: str,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ids (those of the chunk), time range, pop times and counts of every group, a row per group and chunk."""
    by = (by,) if isinstance(by, str) else tuple(by)
    keys = [*by, "merge_event_id", "chunk"]
    at, popped = F.col(order), F.when(F.col(pop_time).isNotNull(), F.col(order))
    rows = _chunked(checkpoint(grouped.sparkSession, grouped.select(
        *by, "merge_event_id", "idx", *dict.fromkeys([order, "protocol", ident, ts_ms, pop_time, ingest])), "grouped"), chunk_rows)
    narrow = rows.groupBy(*keys).agg(
        F.min_by("protocol", at).alias("protocol"), F.min_by(ident, at).alias("first_id"), F.min(ts_ms).alias("ts_ms_min"),
        F.max(ts_ms).alias("ts_ms_max"), F.min_by(pop_time, popped).alias("pop_time_first"),
        F.max_by(pop_time, popped).alias("pop_time_last"), F.count(F.lit(1)).alias("raw_count"),
        F.min(ingest).alias("ingest_id_min"), F.max(ingest).alias("ingest_id_max"))
    g = _over_chunks(narrow, by, {
        "protocol": F.first, "first_id": F.first, "ts_ms_min": F.min, "ts_ms_max": F.max, "pop_time_first": F.first,
        "pop_time_last": F.last, "raw_count": F.sum, "ingest_id_min": F.min, "ingest_id_max": F.max})
    g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ts_ms_min", "ts_ms_max")})
    return rows.groupBy(*keys).agg(_ordered_list(F.col(ident), F.col("idx"), False).alias("ids")).join(g, keys)


def group_sketch(grouped: DataFrame, by, protocols=MERGE_PROTOCOLS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What the features of a merged packet need of its lists, a row per group of any length: ``(.., sketch)``.

    Everything adds up over chunks and map-side: counts, ranges and moments of
    the address and value lists, length and blanks of the payload list, and the
    first value per address.  A part of the sketch is null where the group has one
    distinct value of the field, which the merged packet then holds as its own text.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    keys = [*by, "merge_event_id"]
    have = [f for f in SKETCHED if f in grouped.columns]
    rows = _chunked(grouped.select(*keys, "idx", F.col("protocol").alias("_proto"), *have), chunk_rows)
    narrow = rows.groupBy(*keys, "chunk").agg(
        F.min_by("_proto", "idx").alias("_proto"), *[e for f in have for e in (
            F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"), F.min(F.when(F.col(f).isNotNull(), F.col("idx"))).alias(f"_at_{f}"),
            F.max(F.size((C.str_list if "addr" in f else C.float_list)(F.col(f))) > 0).alias(f"_some_{f}"))])
    whole = _over_chunks(narrow, by, {"_proto": F.first} | {
        f"_{k}_{f}": e for f in have for k, e in (("lo", F.min), ("hi", F.max), ("at", F.min), ("some", F.max))})
    listed = whole.select(*keys, "chunk", F.when(F.col("_proto") == "modbus", "modbus").when(
        F.col("_proto").isin("xgt_fen", "xgt-fen"), "xgt_fen").alias("_owner"), *[e for f in have for e in (
            (F.col(f"_lo_{f}") != F.col(f"_hi_{f}")).alias(f"_many_{f}"), F.col(f"_at_{f}"), F.col(f"_some_{f}"))])
    # where a field has one value, that value's list stands for the field, once
    rows = rows.drop("_proto").join(listed, [*keys, "chunk"])
    field = lambda f: F.col(f) if f in have else F.lit(None).cast("string")
    many = lambda f: F.coalesce(F.col(f"_many_{f}"), F.lit(False)) if f in have else F.lit(False)
    there = lambda f: F.col(f"_many_{f}").isNotNull() if f in have else F.lit(False)

    def use(first: str, second: str) -> tuple[Column, Column]:
        """The value of the two fields that the features take, and whether the group has several of it."""
        return F.when(there(first), field(first)).otherwise(field(second)), F.when(there(first), many(first)).otherwise(many(second))

    data = field("xgt_fen_data")
    addr, addr_many = use("modbus_translated_addr", "modbus_regs_addr")
    mine = lambda p, e: F.when(F.col("_owner") == p, e)
    numbers = lambda p, e, on: F.when((F.col("_owner") == p) & on & e.isNotNull(), C.int_list(F.to_json(F.array(e))))
    long = rows.select(
        *keys, numbers("modbus", addr, addr_many).alias("a"), numbers("modbus", field("modbus_regs_val"), many("modbus_regs_val")).alias("v"),
        mine("xgt_fen", F.when(many("xgt_fen_data") & data.isNotNull(), F.to_json(F.array(data)))).alias("d"),
        mine("modbus", addr_many).alias("a_many"), mine("modbus", many("modbus_regs_val")).alias("v_many"))
    items = F.concat(F.transform(F.coalesce("a", F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("a"), F.lit(None).cast("bigint").alias("v"))),
                     F.transform(F.coalesce("v", F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(None).cast("bigint").alias("a"), x.alias("v"))))
    nothing = F.array(F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("v")))
    flat = long.select(*keys, "a_many", "v_many", "d", F.posexplode(F.concat(nothing, items)).alias("_n", "x"))
    payload = F.when(F.col("_n") == 0, F.col("d"))  # once per packet
    a, v = F.col("x.a").cast("double"), F.col("x.v").cast("double")
    blanks = F.length(payload) - F.length(F.replace(payload, F.lit(" "), F.lit("")))
    sums = flat.groupBy(*keys).agg(
        F.max("a_many").alias("a_many"), F.max("v_many").alias("v_many"), F.count(a).alias("a_n"), F.min(a).alias("a_min"),
        F.max(a).alias("a_max"), F.count(v).alias("v_n"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"),
        F.stddev_pop(v).alias("v_std"), F.count(payload).alias("d_n"), F.sum(F.length(payload) - 2).alias("d_chars"),
        F.sum(blanks).alias("d_blanks"))
    some = lambda n, e: F.when(F.col(n) > 0, e).otherwise(0.0)
    sketch = F.struct(
        F.when(F.col("a_many"), F.struct(
            F.col("a_n").cast("double").alias("count"), some("a_n", F.col("a_min")).alias("min"), some("a_n", F.col("a_max")).alias("max"),
            some("a_n", F.col("a_max") - F.col("a_min")).alias("range"))).alias("addrs"),
        F.when(F.col("v_many"), F.struct(*[some("v_n", F.col(f"v_{k}")).alias(k) for k in ("min", "max", "mean", "std")])).alias("vals"),
        F.when(F.col("d_n") > 0, F.struct((F.col("d_chars") + F.col("d_n") + 1).cast("double").alias("len_chars"),
                                          F.col("d_blanks").cast("double").alias("num_spaces"))).alias("data"))
    slots = _first_values(rows, keys, chunk_rows, field, many, there)
    return sums.select(*keys, sketch.alias("_s")).join(slots, keys, "left").select(
        *keys, F.struct("_s.addrs", "_s.vals", "_s.data", "slots").alias("sketch"))


def _first_values(rows: DataFrame, keys: list[str], chunk_rows: int, field, many, there) -> DataFrame:
    """First value per address over a group's concatenated lists: the n-th address meets the n-th value.

    Places in the concatenation are running totals over blocks of a group, so a
    long group is spread; a map holds one entry per address.
    """
    empty = F.array().cast("array<string>")
    text = lambda f: F.when(field(f).isNotNull(), C.str_list(F.when(many(f), F.to_json(F.array(field(f)))).otherwise(field(f))))
    number = lambda f: F.when(field(f).isNotNull(), C.float_list(F.when(many(f), F.to_json(F.array(field(f)))).otherwise(field(f))))

    def once(f: str, e: Column) -> Column:
        """A field with one value counts once, on the packet that has it first."""
        return F.when(many(f) | (F.col(f"_at_{f}") == F.col("idx")), e)

    fields = {"modbus": ("modbus_translated_addr", "modbus_regs_addr", "modbus_word_value", "modbus_regs_val"),
              "xgt_fen": ("xgt_fen_translated_addr", None, "xgt_fen_word_value", None)}
    named = [f for fs in fields.values() for f in fs if f and f in rows.columns]
    if not named:
        return rows.select(*keys).distinct().withColumn("slots", F.lit(None).cast("map<string,double>"))
    # one address list and one value list per packet, those that the merged packet's features take
    filled = lambda f: F.coalesce(F.col(f"_some_{f}"), F.lit(False)) if f in named else F.lit(False)

    def pick(a: str | None, b: str | None, e) -> Column:
        of = lambda f: once(f, e(f)) if f in named else F.lit(None)
        if b not in named:
            return of(a) if a in named else F.lit(None).cast("array<string>")
        return F.when(filled(a), of(a)).otherwise(of(b)) if a in named else of(b)

    k = v = None
    for proto, (a1, a2, v1, v2) in fields.items():
        own = F.col("_owner") == proto
        kp, vp = pick(a1, a2, text), pick(v1, v2, number)
        k = F.when(own, kp) if k is None else k.when(own, kp)
        v = F.when(own, vp) if v is None else v.when(own, vp)
    r = rows.select(*keys, "idx", F.coalesce(k, empty).alias("_k"), F.coalesce(v, F.array().cast("array<double>")).alias("_v"))
    t = Track(tuple(keys), ("idx",), F.floor(F.col("idx") / F.lit(chunk_rows)))
    r = with_running_sum(r, t, {"_nk": F.size("_k").cast("bigint"), "_nv": F.size("_v").cast("bigint")})
    places = lambda items, end, kind: F.transform(items, lambda x, i: F.struct(
        (end - F.size(items) + i).alias("p"), (x if kind == "k" else F.lit(None).cast("string")).alias("k"),
        (x if kind == "v" else F.lit(None).cast("double")).alias("v")))
    e = r.select(*keys, F.explode(F.concat(places(F.col("_k"), F.col("_nk"), "k"), places(F.col("_v"), F.col("_nv"), "v"))).alias("x"))
    pairs = e.groupBy(*keys, F.col("x.p").alias("p")).agg(F.max("x.k").alias("k"), F.max("x.v").alias("v"))
    best = pairs.where("k IS NOT NULL AND v IS NOT NULL").groupBy(*keys, "k").agg(F.min_by("v", "p").alias("v"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("slots"))


def audit_before(grouped: DataFrame, by, *columns: str) -> DataFrame:
    """Audit rows of the packets going into the merge."""
    by = (by,) if isinstance(by, str) else tuple(by)
    return grouped.select(*by, "merge_event_id", "idx", *columns)


def audit_after(merged: DataFrame, by, *columns: str) -> DataFrame:
    """Audit rows of the packets coming out: one per group."""
    by = (by,) if isinstance(by, str) else tuple(by)
    return merged.where("chunk = 0").select(*by, "merge_event_id", F.lit(0).cast("bigint").alias("idx"), "raw_count",
                         F.lit(1).cast("bigint").alias("merged_count"), *columns)


def merge_totals(merged: DataFrame, by=()) -> DataFrame:
    """Raw packets in, groups out."""
    by = (by,) if isinstance(by, str) else tuple(by)
    return merged.where("chunk = 0").groupBy(*by).agg(F.sum("raw_count").alias("packets_in"), F.count(F.lit(1)).alias("groups_out"))
