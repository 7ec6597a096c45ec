"""Reading packet captures: JSON lines, envelopes, several streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railtap.functions.coerce import iso_epoch_ms, to_int
from railtap.operators.order import Track, with_ordinal
from railtap.schema import PACKET_FIELDS, packet_columns, packet_scan_schema, raw_field_names

_META = "struct<redis_id:string,redis_timestamp_ms:string,packet_timestamp_ms:string,pop_time:string,protocol:string>"
# Objects that hold a protocol's fields one level down.
_NESTED = ("modbus", "s7comm", "xgt_fen", "xgt-fen", "arp", "dns")


def _origin_schema() -> T.StructType:
    """Flat dotted fields, the hyphen spelling of XGT, and nested protocol objects, all text."""
    s = T.StructType(list(packet_scan_schema().fields))
    for raw in raw_field_names():
        if raw.startswith("xgt_fen."):
            s.add("xgt-fen." + raw.split(".", 1)[1], T.StringType())
    for p in _NESTED:
        fields = PACKET_FIELDS[p.replace("-", "_")]
        s.add(p, T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return s


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file's full path, its short ``name`` and the line number (from 1).

    A file is numbered split by split: rows of a split keep their order, splits
    are ordered by their offset, so no file has to pass through one task.
    """
    rows = (spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row")))
    t = Track(("file",), ("_at", "_row"), F.col("_at"))
    return with_ordinal(rows, t, "line_no", start=1).drop("_at", "_row")


def parse_objects(lines: DataFrame, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """One struct ``obj`` per line; blank lines and lines that are no JSON object are skipped.

    ``keep_bad`` keeps the unparsable ones with their text in ``raw``.
    """
    full = T.StructType(list(schema.fields)).add("_bad", T.StringType())
    text = F.trim("value")
    obj = F.from_json(text, full, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(text != "").withColumn("obj", obj)
    good = text.startswith("{") & F.col("obj").isNotNull() & F.col("obj._bad").isNull()
    if not keep_bad:
        return rows.where(good).drop("value")
    return rows.withColumn("raw", F.when(~good, F.col("value"))).withColumn("obj", F.when(good, F.col("obj"))).drop("value")


def flatten_origin(origin: Column) -> list[Column]:
    """Flat packet columns of a parsed packet: dotted field first, then the nested object's."""
    out = []
    for raw, name in raw_field_names().items():
        options = [origin.getField(raw)]
        proto, _, field = raw.partition(".")
        if name == "timestamp":
            options = [F.nullif(origin.getField("@timestamp"), F.lit("")), origin.getField("timestamp")]
        if field:
            if proto == "xgt_fen":
                options.append(origin.getField(f"xgt-fen.{field}"))
            flat = name[len(proto) + 1:]
            for p in (proto, proto.replace("_", "-")):
                if p in _NESTED and flat in PACKET_FIELDS[proto]:
                    options.append(origin.getField(p).getField(flat))
        out.append(F.coalesce(*options).alias(name))
    return out


def read_packets(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """Packets of a JSONL capture with their envelope.

    A line is a bare packet or ``{"origin": packet, "_meta": {...}}``.  Missing
    protocol becomes the envelope's, else ``unknown``; a timestamp that gives no
    positive time is replaced by the line number; a missing id names the line.
    """
    schema = _origin_schema().add("origin", _origin_schema()).add("_meta", T.StructType.fromDDL(_META[7:-1]))
    rows = parse_objects(read_lines(spark, path), schema, keep_bad)
    wrapped = F.col("obj.origin").isNotNull()
    bare = [c for c in flatten_origin(F.col("obj"))]
    inner = [c for c in flatten_origin(F.col("obj.origin"))]
    names = packet_columns()
    picked = [F.when(wrapped, i).otherwise(b).alias(n) for i, b, n in zip(inner, bare, names)]
    keep = ["raw"] if keep_bad else []
    meta = F.when(wrapped, F.col("obj._meta"))
    out = rows.select("file", "line_no", *keep, meta.alias("_meta"), *picked)
    proto = F.coalesce(F.nullif("protocol", F.lit("")), F.nullif(F.col("_meta.protocol"), F.lit("")), F.lit("unknown"))
    ms = iso_epoch_ms(F.col("timestamp"))
    ms = F.when(ms > 0, ms).otherwise(F.col("line_no"))

    def or_ms(c: str) -> Column:
        given = to_int(F.col(f"_meta.{c}"))
        return F.coalesce(F.when(given != 0, given), ms)

    ident = F.coalesce(F.nullif(F.col("_meta.redis_id"), F.lit("")),
                       F.concat(F.lit("file:"), "file", F.lit(":"), F.col("line_no").cast("string")))
    meta_out = F.struct(ident.alias("id"), or_ms("redis_timestamp_ms").alias("ts_ms"),
                        or_ms("packet_timestamp_ms").alias("packet_ts_ms"),
                        F.col("_meta.pop_time").alias("pop_time"), proto.alias("protocol"))
    return out.withColumn("meta", meta_out).withColumn("protocol", proto).drop("_meta")


def stream_id(ident: Column) -> tuple[Column, Column]:
    """(milliseconds, sequence) of a ``ms-seq`` stream id; (0, 0) when it is not one."""
    ok = ident.rlike(r"^\d{1,18}-\d{1,18}$")
    part = F.split(ident, "-")
    zero = F.lit(0).cast("bigint")
    return (F.when(ok, part[0].try_cast("bigint")).otherwise(zero),
            F.when(ok, F.get(part, 1).try_cast("bigint")).otherwise(zero))


def union_streams(streams: list[DataFrame], ident: str) -> DataFrame:
    """Several streams as one, each row with its oldest-first order key ``(ts_ms, id_seq)``."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    ms, seq = stream_id(F.col(ident))
    return out.withColumn("ts_ms", ms).withColumn("id_seq", seq)


def check_capture(spark: SparkSession, path: str) -> None:
    """Fail fast on a capture that is empty or whose first record is no JSON object."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1)
    schema = T.StructType.fromDDL("`@timestamp` STRING, _bad STRING")
    obj = F.from_json(F.trim("value"), schema, {"columnNameOfCorruptRecord": "_bad"})
    got = head.withColumn("o", obj).select((F.trim("value").startswith("{") & F.col("o").isNotNull()
                                            & F.col("o._bad").isNull()).alias("ok")).collect()
    if not got:
        raise ValueError(f"{path} holds no records")
    if not got[0]["ok"]:
        raise ValueError(f"the first record of {path} is not a JSON object")
