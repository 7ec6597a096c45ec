"""Batch jobs: fit once, featurise windows, several tagged inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtap.operators.features import featurise, fit
from railtap.operators.fit import Fitted


def fit_and_save(packets: DataFrame, path: str, order: str = "seq", missing_as_zero: bool = True) -> Fitted:
    """Fit every parameter table from raw packets, store them and hand back the stored tables."""
    fit(packets, order, missing_as_zero).save(path)
    return Fitted.load(packets.sparkSession, path)


def featurise_windows(windows: DataFrame, window: str, sequence: str, fitted: Fitted,
                      carry: list[str] | None = None) -> DataFrame:
    """Windows of packets to windows of feature rows.

    Packets are laid out, featurised by projection and gathered per window
    again; windows of at most one packet are skipped.
    """
    carry = carry or []
    rows = (windows.where(F.size(sequence) > 1)
            .select(window, *carry, F.posexplode(sequence).alias("_pos", "_pkt"))
            .select(window, *carry, "_pos", "_pkt.*"))
    feats = featurise(rows, fitted, [window, *carry, "_pos"])
    names = [c for c in feats.columns if c not in (window, *carry, "_pos")]
    ordered = F.array_sort(F.collect_list(F.struct("_pos", *names)))
    body = F.transform(ordered, lambda s: F.struct(*[s[n].alias(n) for n in names]))
    return feats.groupBy(window, *carry).agg(body.alias("sequence_group"))


def tagged_union(inputs: dict[str, DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """Several inputs as one table with a ``tag``; a column an input lacks takes its default."""
    parts = []
    for tag, df in inputs.items():
        for c, v in (defaults or {}).items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(v))
        parts.append(df.withColumn("tag", F.lit(tag)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
