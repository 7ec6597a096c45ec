"""Fitted dictionaries, feature policies and catalogs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_dictionary(spark: SparkSession, path: str, key: str = "token", value: str = "id",
                    value_type: str = "bigint") -> DataFrame:
    """A JSON object file as rows ``(key, value)``; no rows when the file is absent or no object."""
    empty = spark.createDataFrame([], f"{key} string, {value} {value_type}")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    entries = F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,string>")
    return text.select(F.explode(entries).alias(key, value)).withColumn(value, F.col(value).try_cast(value_type))


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Ranges from a JSON object with ``<name>_min`` / ``<name>_max`` keys."""
    d = load_dictionary(spark, path, "k", "v", "double")
    end = F.regexp_extract("k", "_(min|max)$", 1)
    return (d.where(end != "").groupBy(F.regexp_replace("k", "_(min|max)$", "").alias("feature"))
            .agg(F.max(F.when(end == "min", F.col("v"))).alias("vmin"), F.max(F.when(end == "max", F.col("v"))).alias("vmax")))


def save_dictionary(df: DataFrame, path: str, key: str, value: str) -> None:
    """Rows ``(key, value)`` as JSON lines ``{"key": value}``; the partitioned form of a dictionary file."""
    df.select(F.to_json(F.create_map(key, value)).alias("value")).write.mode("overwrite").text(path)


def parse_policy(lines: DataFrame, text: str = "value") -> DataFrame:
    """Feature policy lines ``[O|X] name [weight]``: name, use flag and weight; comments and blanks are skipped.

    A missing flag means use, a missing or unreadable weight means 1.
    """
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    part = F.split(t, " ")
    flagged = F.upper(part[0]).isin("O", "X")
    name = F.when(flagged, F.get(part, 1)).otherwise(part[0])
    weight = F.when(flagged, F.get(part, 2)).otherwise(F.get(part, 1)).try_cast("double")
    use = ~(flagged & (F.upper(part[0]) == "X"))
    rows = lines.where((t != "") & ~t.startswith("#")).withColumns(
        {"name": name, "use": use, "weight": F.coalesce(weight, F.lit(1.0))})
    return rows.where(F.col("name").isNotNull())


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return parse_policy(spark.read.text(path)).select("name", "use", "weight")


def feature_names(lines: DataFrame, text: str = "value") -> DataFrame:
    """Feature list lines: the last token of each."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return lines.where((t != "") & ~t.startswith("#")).withColumn("name", F.element_at(F.split(t, " "), -1))


def catalog(spark: SparkSession, features: list[str], weight: float = 1.0) -> DataFrame:
    """Feature catalog: protocol, time delta, the features and match, each once, in that order."""
    names = list(dict.fromkeys(["protocol", "delta_t", *features, "match"]))
    return spark.createDataFrame([(i, n, True, float(weight)) for i, n in enumerate(names)],
                                 "pos int, name string, use boolean, weight double")


def catalog_lines(cat: DataFrame) -> DataFrame:
    """Catalog as policy text lines."""
    flag = F.when(F.col("use"), "O").otherwise("X")
    return cat.orderBy("pos").select(F.format_string("%s %-28s %.1f", flag, F.col("name"), F.col("weight")).alias("value"))


def select_features(keys: DataFrame, policy: DataFrame, key: str = "name") -> DataFrame:
    """Distinct keys minus the excluded ones with their weight (1 when the policy has none), ordered by name."""
    rules = policy.groupBy("name").agg(F.bool_and("use").alias("_use"), F.max(F.when(F.col("use"), F.col("weight"))).alias("weight"))
    out = keys.select(F.col(key).alias("name")).distinct().join(rules, "name", "left")
    return (out.where(F.coalesce("_use", F.lit(True)))
            .select("name", F.coalesce("weight", F.lit(1.0)).alias("weight")).orderBy("name"))
