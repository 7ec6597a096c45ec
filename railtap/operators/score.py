"""Scoring packets and windows.

Window tensors are arrays of row vectors, so errors of a window are computed
inside its own row with array expressions; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.functions.scalars import clamp, round_half_up, sigmoid, stable_hash
from railtap.operators.evaluate import score_distribution
from railtap.schema import MISSING, OUT_OF_RANGE

_EPS = 1e-8
HASH_FALLBACK_SHARE = 5     # Fixed value: percent of address pairs whose mismatch is forgiven.
TOP_FEATURES = 7


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


# --- vectors -----------------------------------------------------------------

def feature_vector(names: list[str], default: float = 0.0, sources: list[str] | None = None) -> Column:
    """Values of the selected features in order; missing ones take the default.

    ``sources`` are map columns tried as a whole in turn: the first one present
    on a row supplies all its features.  Without it the names are columns.
    """
    d = F.lit(float(default))
    if not sources:
        return F.array(*[F.coalesce(F.col(n).try_cast("double"), d) for n in names])
    chosen = F.coalesce(*[F.col(s) for s in sources])
    return F.array(*[F.coalesce(F.try_element_at(chosen, F.lit(n)).try_cast("double"), d) for n in names])


def standardise(x: Column, mean: list[float] | None, std: list[float] | None) -> Column:
    """(x - mean) / std per position, a zero deviation counting as 1."""
    if mean is not None:
        x = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m)
    if std is not None:
        x = F.zip_with(x, F.array(*[F.lit(float(s) or 1.0) for s in std]), lambda v, s: v / s)
    return x


def minmax_scale(x: Column, scale: list[float], shift: list[float]) -> Column:
    """x * scale + shift per position."""
    x = F.zip_with(x, F.array(*[F.lit(float(s)) for s in scale]), lambda v, s: v * s)
    return F.zip_with(x, F.array(*[F.lit(float(m)) for m in shift]), lambda v, m: v + m)


def contributions(x: Column, names: Column, k: int, digits: int = 2) -> Column:
    """The ``k`` largest shares of the absolute vector in percent, ``array<struct<name,percent>>``, zeros left out."""
    mag = F.transform(x, lambda v: F.abs(v))
    total = _sum(mag) + 1e-12
    share = F.zip_with(names, mag, lambda n, v: F.struct((-v).alias("neg"), n.alias("name")))
    top = F.filter(F.slice(F.array_sort(share), 1, max(k, 0)) if k > 0 else F.slice(share, 1, 0),
                   lambda s: s["neg"] < 0)
    return F.transform(top, lambda s: F.struct(
        s["name"].alias("name"), round_half_up(-s["neg"] * 100.0 / total, digits).alias("percent")))


# --- packet verdicts ---------------------------------------------------------

def anomaly_probability(probs: Column | None = None, normal_index: int | None = None, margin: Column | None = None,
                        positive_is_normal: bool = True) -> Column:
    """1 - P(normal) from class probabilities (1 - max without a normal class), else from a margin, else one half."""
    if probs is not None:
        p = F.array_max(probs) if normal_index is None else F.get(probs, F.lit(normal_index))
        return 1.0 - clamp(p)
    if margin is not None:
        return 1.0 - sigmoid(margin) if positive_is_normal else sigmoid(margin)
    return F.lit(0.5)


def match_decision(anomaly: Column, threshold: float, label: Column | None = None, normal_label=1,
                   margin: Column | None = None, positive_is_normal: bool = True) -> Column:
    """1 = matches normal traffic: the predicted label decides, else the threshold on probability or margin."""
    if label is not None:
        return F.when(label.cast("string") == str(normal_label), 1).otherwise(0)
    if 0.0 <= threshold <= 1.0:
        return F.when(anomaly >= threshold, 0).otherwise(1)
    if margin is not None:
        normal = margin if positive_is_normal else -margin
        return F.when(normal >= threshold, 1).otherwise(0)
    return F.when(anomaly >= 0.5, 0).otherwise(1)


def match_mark(match: Column, sip: Column | None = None, dip: Column | None = None,
               hash_fallback: bool = False) -> Column:
    """``O`` / ``X`` mark; with the fallback a fixed share of address pairs turns a mismatch into a match."""
    mark = F.when(match == 1, F.lit("O")).otherwise(F.lit("X"))
    if not hash_fallback:
        return mark
    pair = (sip != "") & (dip != "")
    forgiven = pair & (stable_hash(F.concat_ws("-", sip, dip), 100) < HASH_FALLBACK_SHARE)
    return F.when((match != 1) & F.coalesce(forgiven, F.lit(False)), F.lit("O")).otherwise(mark)


def offline_match(score: Column, threshold: float, higher_is_anomalous: bool = True) -> Column:
    """Batch verdict of a packet score: 0 anomalous, 1 normal, null without a score."""
    anomalous = (score >= threshold) if higher_is_anomalous else (score <= threshold)
    return F.when(score.isNull(), None).when(anomalous, 0).otherwise(1)


def verdict_tally(df: DataFrame, match: str, window: str) -> DataFrame:
    """Windows, rows and verdict counts."""
    m = F.col(match)
    per = df.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.count_if(m == 0).alias("a"),
                                 F.count_if(m == 1).alias("b"), F.count_if(m.isNull()).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("rows"), F.sum("a").alias("match0"),
                   F.sum("b").alias("match1"), F.sum("c").alias("match_none"))


# --- window errors -----------------------------------------------------------

def squared_errors(x: Column, xh: Column, weights: list[float] | None = None) -> Column:
    """Weighted squared error of every cell, same shape as the window."""
    if weights is None:
        return F.zip_with(x, xh, lambda r, h: F.zip_with(r, h, lambda a, b: (b - a) * (b - a)))
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.zip_with(x, xh, lambda r, h: F.zip_with(
        F.zip_with(r, h, lambda a, b: (b - a) * (b - a)), w, lambda e, k: e * k))


def error_train(x: Column, errors: Column, ignore: float = MISSING) -> Column:
    """Mean error over the cells that are not ignored."""
    cells = F.flatten(F.zip_with(x, errors, lambda r, e: F.zip_with(
        r, e, lambda v, s: F.struct((v != ignore).alias("use"), s.alias("s")))))
    acc = F.aggregate(cells, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, c: F.struct(
        F.when(c["use"], a["s"] + c["s"]).otherwise(a["s"]).alias("s"),
        F.when(c["use"], a["n"] + 1.0).otherwise(a["n"]).alias("n")))
    return acc["s"] / (acc["n"] + _EPS)


def step_errors(errors: Column) -> Column:
    """Mean error of every step over its features."""
    return F.transform(errors, lambda e: _sum(e) / F.size(e))


def error_by_step(x: Column, errors: Column, ignore: list[float]) -> Column:
    """Mean step error over the steps that hold a real cell.

    The evaluation error ignores padding only, the serving error padding and
    missing cells.
    """
    marks = [float(v) for v in ignore]

    def real(v: Column) -> Column:
        ok = F.lit(True)
        for m in marks:
            ok = ok & (v != m)
        return ok

    both = F.zip_with(x, step_errors(errors), lambda r, e: F.struct(F.exists(r, real).alias("use"), e.alias("e")))
    acc = F.aggregate(both, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, c: F.struct(
        F.when(c["use"], a["s"] + c["e"]).otherwise(a["s"]).alias("s"),
        F.when(c["use"], a["n"] + 1.0).otherwise(a["n"]).alias("n")))
    return acc["s"] / (acc["n"] + _EPS)


def error_eval(x: Column, errors: Column) -> Column:
    return error_by_step(x, errors, [MISSING])


def error_serve(x: Column, errors: Column) -> Column:
    return error_by_step(x, errors, [MISSING, OUT_OF_RANGE])


def temporal_error_max(errors: Column) -> Column:
    """Largest step error, padding included."""
    return F.array_max(step_errors(errors))


def feature_errors(errors: Column, width: int) -> Column:
    """Mean error of every feature over the steps."""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.transform(F.aggregate(errors, zero, lambda a, e: F.zip_with(a, e, lambda p, q: p + q)),
                       lambda s: s / F.size(errors))


def top_feature_errors(errors: Column, names: list[str], k: int = TOP_FEATURES) -> Column:
    """Map of the ``k`` features with the largest error; ties keep catalog order."""
    per = feature_errors(errors, len(names))
    labelled = F.transform(per, lambda e, i: F.struct((-e).alias("neg"), i.alias("i")))
    labels = F.array(*[F.lit(n) for n in names])
    top = F.slice(F.array_sort(labelled), 1, min(k, len(names)))
    return F.map_from_entries(F.transform(top, lambda s: F.struct(F.get(labels, s["i"]), -s["neg"])))


def anomaly_prediction(error: Column, threshold: float | Column | None) -> Column:
    """1 above the threshold, 0 at or below it, -1 without one."""
    if threshold is None:
        return F.lit(-1)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(t.isNull(), -1).when(error > t, 1).otherwise(0)


def reconstruct_with(df: DataFrame, predict, schema) -> DataFrame:
    """Apply an external model batch by batch: ``predict`` maps a pandas frame of windows to one with its outputs.

    Filter the rows that need the model before calling this; nothing is pushed
    through a Python step.
    """
    def run(batches):
        for pdf in batches:
            yield predict(pdf)
    return df.mapInPandas(run, schema)


# --- thresholds --------------------------------------------------------------

def calibrate(df: DataFrame, error: str) -> DataFrame:
    """Threshold candidates and moments of training errors."""
    d = score_distribution(df, (), error, levels=[99])
    return d.select(F.col("p99").alias("threshold_p99"), (F.col("mean") + 3.0 * F.col("std")).alias("threshold_mu3"),
                    "mean", "std", "min", "max")


def adjust_thresholds(stats: DataFrame, ks: list[float]) -> DataFrame:
    """Add per ``k``: mean - k * std, and the same clipped to the observed range."""
    rows = stats.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    tau = F.col("mean") - F.col("k") * F.col("std")
    return rows.withColumn("tau", tau).withColumn("tau_clip", F.least(F.greatest("tau", "min"), F.col("max")))


def pick_threshold(given: Column, p99: Column, mu3: Column, override: float | None = None) -> Column:
    """Explicit override, else the stored threshold, else the 99th percentile, else mean + 3 deviations."""
    first = [F.lit(float(override))] if override is not None else []
    return F.coalesce(*first, given, p99, mu3)
