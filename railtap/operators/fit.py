"""Fitting ranges and vocabularies from packets.

All ranges come from one job over the columns they need.  Vocabularies are
distinct token tables numbered block-wise, so a vocabulary may outgrow a task.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions import scalars as S
from railtap.operators.order import Track, numeric_blocks, text_blocks, with_ordinal
from railtap.schema import MISSING
from railtap.session import block_count, checkpoint

#: Values per aggregate of :func:`ranges`.
VALUES_TOGETHER = 16


@dataclass
class Fitted:
    """Fitted parameter tables."""
    host_vocab: DataFrame    # token, id
    arp_vocab: DataFrame     # token, id
    var_vocab: DataFrame     # name, id
    norm_params: DataFrame   # feature, vmin, vmax
    slot_params: DataFrame   # proto, addr, slot, vmin, vmax

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Fitted":
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def host_token(ip: Column, mac: Column) -> Column:
    """``ip|mac`` of an endpoint, null when either is blank."""
    i, m = F.trim(ip), F.trim(mac)
    return F.when((i != "") & (m != ""), F.concat(i, F.lit("|"), m))


def token_table(df: DataFrame, entries: Column, order: str) -> DataFrame:
    """Every distinct (kind, token) with where it first occurs and the range of its values.

    ``entries`` is an array of ``struct<kind,token,v>`` per packet.  All
    vocabularies and slots come from this one scan; counts shrink map-side and
    the written result is what they are numbered from.
    """
    e = df.select(F.col(order).alias("_o"), F.explode(F.filter(entries, lambda x: x["token"].isNotNull())).alias("e"))
    table = e.groupBy("e.kind", "e.token").agg(F.min("_o").alias("at"), F.min("e.v").alias("vmin"),
                                               F.max("e.v").alias("vmax"))
    return checkpoint(df.sparkSession, table, "tokens")


def entry(kind: str, token: Column, value: Column | None = None) -> Column:
    v = value if value is not None else F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), token.alias("token"), v.cast("double").alias("v"))


def _numbered(words: DataFrame, keys: list[str], start: int, blocks) -> DataFrame:
    """Dense ids in key order, block by block."""
    rows = words.withColumn("_g", F.lit(0))
    return with_ordinal(blocks(rows, keys[0], "_b"), Track(("_g",), tuple(keys), F.col("_b")), "id", start)


def number_by_text(words: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Distinct tokens numbered in text order."""
    return _numbered(words.select(name), [name], start, text_blocks).select(name, "id")


def number_by_kind(words: DataFrame, kind: str, name: str, start: int = 1) -> DataFrame:
    """Several vocabularies in one job: distinct tokens numbered in text order within their kind."""
    n = block_count(words.sparkSession)
    cut = words.select(kind, name).repartitionByRange(n, kind, name).withColumn("_b", F.spark_partition_id())
    cut = checkpoint(words.sparkSession, cut, "words")   # another run of the range partitioning may cut elsewhere
    return with_ordinal(cut, Track((kind,), (name,), F.col("_b")), "id", start).select(kind, name, "id")


def number_by_first_use(words: DataFrame, name: str, at: str = "at") -> DataFrame:
    """Distinct tokens numbered from 1 by where they first occur."""
    return _numbered(words.select(name, at), [at, name], 1, numeric_blocks).select(name, "id")


def sorted_vocabulary(df: DataFrame, tokens: list[Column], name: str = "token", start: int = 1) -> DataFrame:
    """Distinct tokens of several columns, numbered in text order."""
    words = df.select(F.explode(F.array_compact(F.array(*tokens))).alias(name)).distinct()
    return number_by_text(checkpoint(df.sparkSession, words, "words"), name, start)


def first_seen_vocabulary(df: DataFrame, value: Column, order: str, name: str = "name") -> DataFrame:
    """Distinct names numbered from 1 by where they first occur."""
    first = df.select(value.alias(name), order).where(F.col(name).isNotNull()) \
        .groupBy(name).agg(F.min(order).alias("at"))
    return number_by_first_use(checkpoint(df.sparkSession, first, "words"), name)


def ranges(df: DataFrame, values: dict[str, Column], missing_as_zero: bool = True) -> DataFrame:
    """Min and max of every value as rows ``(feature, vmin, vmax)``, in one job.

    A missing value counts as 0 by default; without any packet both ends are -1.
    Values are aggregated a few at a time: each part reads only its own columns
    and stays small enough to be compiled, which one wide aggregate is not.
    """
    parts, names = [], list(values)
    for at in range(0, len(names), VALUES_TOGETHER):
        some = names[at:at + VALUES_TOGETHER]
        # values become columns first: the aggregate then refers to each of them twice, not to its formula
        rows = df.select(*[values[n].cast("double").alias(n) for n in some])
        aggs = []
        for n in some:
            d = F.col(n)
            d = F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0)) if missing_as_zero else F.when(~F.isnan(d), d)
            aggs += [F.coalesce(F.min(d), F.lit(MISSING)).alias(f"{n}|vmin"), F.coalesce(F.max(d), F.lit(MISSING)).alias(f"{n}|vmax")]
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}|vmin`").alias("vmin"), F.col(f"`{n}|vmax`").alias("vmax"))
                          for n in some])
        parts.append(rows.agg(*aggs).select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def slot_pairs(protocol: str, addresses: Column, values: Column) -> Column:
    """Address and value pairs a packet contributes to slot fitting, zipped to the shorter list."""
    if protocol == "modbus":
        keys = F.transform(C.float_list(addresses), lambda x: x.cast("bigint").cast("string"))
    else:
        keys = F.filter(C.str_list(addresses), lambda s: ~F.lower(s).isin("nan", "none", "null"))
    nums = F.filter(C.float_list(values), lambda x: ~F.isnan(x))
    return S.zip_shortest(keys, nums)


def slot_entries(columns: dict[str, tuple[str, str]]) -> Column:
    """Pairs of a packet by protocol; ``columns`` maps a protocol to its address and value columns."""
    pairs = F.array().cast("array<struct<k:string,v:double>>")
    for proto, (a, v) in columns.items():
        pairs = F.when(F.col("protocol") == proto, slot_pairs(proto, F.col(a), F.col(v))).otherwise(pairs)
    return pairs


def slot_ranges(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Min and max per (protocol, address)."""
    e = df.select(F.col("protocol").alias("proto"), F.explode(slot_entries(columns)).alias("p"))
    return e.groupBy("proto", F.col("p.k").alias("addr")).agg(F.min("p.v").alias("vmin"), F.max("p.v").alias("vmax"))


def number_slots(ranges_: DataFrame, numeric=("modbus",)) -> DataFrame:
    """Slot ids from 0 per protocol, by number for register addresses and by text for the others.

    Slots become feature columns, so a protocol has at most a register space of
    them; one sort per protocol is bounded by that.
    """
    num = F.when(F.col("proto").isin(*numeric), F.col("addr").try_cast("bigint"))
    w = W.partitionBy("proto").orderBy(num.asc_nulls_last(), "addr")
    return ranges_.withColumn("slot", (F.row_number().over(w) - 1).cast("bigint"))
