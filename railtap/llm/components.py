"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtap.llm.common import stored


def _least(df: DataFrame) -> DataFrame:
    """The smallest of u and its neighbours; written, so that the join after it can split a hub."""
    return stored(df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "star-least")


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each node that is not the smallest of its component: v is that smallest one.

    ``links`` has two long columns a and b.  Each round hangs every node on the
    smallest node it sees, first from its larger neighbours, then from itself;
    the number of rounds grows with the logarithm of the longest path.  Links
    stay in tables of the shared folder, and only a count and a checksum reach
    the driver.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                   "star-links")
    mark = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .distinct(), "star-large")
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "star-small")
        now = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if now == mark:
            return edges
        mark = now
