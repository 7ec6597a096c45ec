"""Writing results: pruned JSON lines, CSV, run folders, audit records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pruned(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, T.StructType):
        fields = F.struct(*[_pruned(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(t, T.ArrayType):
        return F.filter(F.transform(c, lambda x: _pruned(x, t.elementType)), lambda x: x.isNotNull())
    if isinstance(t, T.MapType):
        return F.map_filter(F.transform_values(c, lambda k, v: _pruned(v, t.valueType)), lambda k, v: v.isNotNull())
    return c


def prune(df: DataFrame) -> DataFrame:
    """Null out NaN and infinity and drop nulls inside arrays and maps, at any depth.

    The JSON writer leaves out null fields, so what is written holds none.
    """
    return df.select(*[_pruned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def as_json(df: DataFrame) -> Column:
    """The pruned row as one JSON text; use on the result of :func:`prune`."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def append_jsonl(df: DataFrame, path: str) -> None:
    prune(df).write.mode("append").json(path)


def write_run(df: DataFrame, path: str) -> None:
    """All results of a run as one folder of JSON lines; a rerun replaces it."""
    prune(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.option("header", True).csv(path)


def count_records(spark: SparkSession, path: str) -> int:
    """Non-blank lines already stored, 0 when nothing is; new ids continue from here."""
    try:
        return spark.read.text(path).where(F.trim("value") != "").count()
    except AnalysisException:
        return 0


def incoming_record(df: DataFrame, ingest_id: str, meta: str = "meta") -> DataFrame:
    """Audit record of an incoming packet: id, protocol, envelope and the packet itself."""
    rest = [c for c in df.columns if c not in (ingest_id, meta)]
    return df.select(F.col(ingest_id).alias("ingest_id"), F.coalesce("protocol", F.col(meta)["protocol"]).alias("protocol"),
                     F.col(meta).alias("_meta"), F.struct(*rest).alias("origin"))


def raw_entry(df: DataFrame, drop=("ml", "ml_anomaly_prob")) -> DataFrame:
    """Packet as stored with its window: model fields out, nulls and non-finite numbers pruned."""
    return prune(df.drop(*drop))


def save_matrices(rows: DataFrame, protocol: str, columns: dict[str, list[str]], path: str, order: str) -> None:
    """Fit matrices: per protocol the rows of its own columns as one typed array each, and the columns' names.

    A matrix is the folder ``matrices/proto=<name>`` in row order of ``order``
    within its files; names and widths are in ``names``.
    """
    def cells(names: list[str]) -> Column:
        return F.array(*[F.col(f"`{n}`").cast("float") for n in names])

    spark = rows.sparkSession
    chosen = F.lit(None).cast("array<float>")
    for name, names in columns.items():
        chosen = F.when(F.col(protocol) == name, cells(names)).otherwise(chosen)
    named = rows.select(F.col(protocol).alias("proto"), F.col(order).alias("row"), chosen.alias("cells")).where(F.col("cells").isNotNull())
    named.sortWithinPartitions("proto", "row").write.mode("overwrite").partitionBy("proto").parquet(f"{path}/matrices")
    catalog = [(p, i, n) for p, names in columns.items() for i, n in enumerate(names)]
    spark.createDataFrame(catalog, "proto string, pos int, name string").write.mode("overwrite").parquet(f"{path}/names")


def load_matrix(spark: SparkSession, path: str, protocol: str) -> tuple[DataFrame, list[str]]:
    """A protocol's matrix as ``(row, cells)``, only its own files read, and its column names."""
    names = spark.read.parquet(f"{path}/names").where(F.col("proto") == protocol).orderBy("pos").select("name").collect()
    m = spark.read.schema("row bigint, cells array<float>, proto string").parquet(f"{path}/matrices").where(F.col("proto") == protocol)
    return m.select("row", "cells"), [r["name"] for r in names]
