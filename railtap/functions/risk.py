"""Asset impact, severity, likelihood, confidence and risk of a window, as Column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from railtap.functions.scalars import clamp, round_half_up, sigmoid

# Calibration of the risk score.
GAMMA = 0.85
ALPHA = 6.0
SEVERITY_SLOPE = 6.0
CONFIDENCE_SLOPE = 3.0
WEIGHT_SEVERITY, WEIGHT_TEMPORAL, WEIGHT_SEMANTIC = 1.00, 0.60, 0.35
WEIGHT_ANOMALY, WEIGHT_PATTERN = 0.65, 0.35
TEMPORAL_DECADES = 6.0
DEFAULT_CLASSES = 10
SMALLEST_THRESHOLD = 1e-12
SERVING_THRESHOLD = 0.32

# Asset keywords and their value, first match wins.
ASSET_VALUES = [
    (("plc", "rtu", "dcs"), 1.00),
    (("hmi", "scada"), 0.85),
    (("hist", "historian"), 0.80),
    (("eng", "engineering"), 0.75),
    (("server",), 0.70),
    (("switch", "router", "fw", "firewall"), 0.65),
]
DEFAULT_ASSET_VALUE = 0.60
CONTROL_PROTOCOLS = ("modbus", "xgt_fen", "xgt-fen", "s7comm", "dnp3", "bacnet")
CONTROL_BONUS = 0.05

# Anomaly-type words that raise an alert.
ALERT_WORDS = ("anomalous", "abnormal", "attack", "anomaly")


def asset_value(name: Column) -> Column:
    """Value of an asset by the first keyword its name holds."""
    text = F.lower(name)
    out = F.when(F.lit(False), F.lit(0.0))
    for words, value in ASSET_VALUES:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = out.when(hit, F.lit(value))
    return out.otherwise(F.lit(DEFAULT_ASSET_VALUE))


def impact(protocol: Column, src_asset: Column, dst_asset: Column) -> Column:
    """Impact in [0, 1]: the target's value (the source's if that is 0), more for control protocols."""
    base = F.when(asset_value(dst_asset) > 0, asset_value(dst_asset)).otherwise(asset_value(src_asset))
    bonus = F.when(F.lower(protocol).isin(*CONTROL_PROTOCOLS), CONTROL_BONUS).otherwise(0.0)
    return clamp(base + bonus)


def _ratio(score: Column, threshold: Column) -> Column:
    return score / F.greatest(threshold, F.lit(SMALLEST_THRESHOLD))


def severity(score: Column, threshold: Column) -> Column:
    return clamp((sigmoid((_ratio(score, threshold) - 1.0) * SEVERITY_SLOPE) - 0.5) * 2.0)


def likelihood(score: Column, threshold: Column, temporal_max: Column, pattern_prob: Column) -> Column:
    """Noisy-or of severity, the worst step and how unsure the pattern is."""
    temporal = clamp(F.log10(F.greatest(temporal_max, F.lit(0.0)) + 1.0) / TEMPORAL_DECADES)
    semantic = F.when(pattern_prob.isNotNull(), clamp(1.0 - pattern_prob)).otherwise(F.lit(0.0))
    miss = F.lit(1.0)
    for part, weight in ((severity(score, threshold), WEIGHT_SEVERITY), (temporal, WEIGHT_TEMPORAL),
                         (semantic, WEIGHT_SEMANTIC)):
        miss = miss * (1.0 - clamp(part * weight))
    return clamp(1.0 - miss)


def confidence(score: Column, threshold: Column, pattern_prob: Column, entropy: Column, classes: Column) -> Column:
    """Weighted mean of score confidence and pattern confidence (one half without a pattern)."""
    of_score = sigmoid((_ratio(score, threshold) - 1.0) * CONFIDENCE_SLOPE)
    top = F.when(classes >= 2, F.log(classes.cast("double"))).otherwise(F.lit(log(DEFAULT_CLASSES)))
    spread = clamp(entropy / F.greatest(top, F.lit(1e-9)))
    known = pattern_prob.isNotNull() & entropy.isNotNull()
    of_pattern = F.when(known, 0.5 * clamp(pattern_prob) + 0.5 * (1.0 - spread)).otherwise(F.lit(0.5))
    return clamp(WEIGHT_ANOMALY * of_score + WEIGHT_PATTERN * of_pattern)


def risk(anomalous: Column, score: Column, threshold: Column, temporal_max: Column, pattern_prob: Column,
         entropy: Column, classes: Column, impact01: Column, zero_when_normal: bool = True) -> dict[str, Column]:
    """Risk score in [0, 100] and its parts; everything but the impact is 0 for a normal window."""
    like = likelihood(score, threshold, temporal_max, pattern_prob)
    conf = confidence(score, threshold, pattern_prob, entropy, classes)
    raw = clamp(impact01 * like * conf)
    cal = clamp(1.0 - F.exp(-ALPHA * raw))
    points = round_half_up(clamp(F.pow(cal, F.lit(GAMMA))) * 100.0, 2)
    parts = {"score": points, "likelihood": round_half_up(like, 4), "confidence": round_half_up(conf, 4),
             "raw01": round_half_up(raw, 6), "cal01": round_half_up(cal, 6)}
    if zero_when_normal:
        parts = {k: F.when(anomalous, e).otherwise(F.lit(0.0)) for k, e in parts.items()}
    return {**parts, "impact": round_half_up(impact01, 4)}


def alert(score: Column, threshold: Column, anomaly_type: Column, risk_score: Column,
          model_alert: Column | None = None) -> Column:
    """Alert rule: score against threshold decides when both exist, else the type word, else a positive risk.

    A model's own alert is or-ed in.
    """
    out = (F.when(score.isNotNull() & threshold.isNotNull(), score >= threshold)
           .when(F.lower(F.trim(anomaly_type)).isin(*ALERT_WORDS), F.lit(True))
           .otherwise(F.coalesce(risk_score, F.lit(0.0)) > 0))
    return out if model_alert is None else F.coalesce(model_alert, F.lit(False)) | out


def class_summary(probs: Column) -> dict[str, Column]:
    """Top class, its probability, entropy, similarity in percent and confidence distance of a probability array."""
    p = F.array_max(probs)
    clipped = F.transform(probs, lambda x: clamp(x, 1e-12, 1.0))
    ent = F.aggregate(clipped, F.lit(0.0), lambda a, x: a - x * F.log(x))
    return {"pattern_index": (F.array_position(probs, p) - 1).cast("int"), "pattern_prob": p,
            "similarity": p * 100.0, "probs_entropy": ent, "num_classes": F.size(probs),
            "latent_distance": -F.log(clamp(p, 1e-12, 1.0))}
