"""Window verdicts: anomaly and pattern results, risk, alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.functions import risk as R


def merge_results(anomaly: DataFrame, pattern: DataFrame, keys: list[str], always: bool = True) -> DataFrame:
    """Pattern results beside anomaly results; without ``always`` only where the window is anomalous.

    Apply the pattern model to :func:`needs_pattern` windows only in that case.
    """
    out = anomaly.join(pattern, keys, "left")
    if always:
        return out
    extra = [c for c in pattern.columns if c not in keys]
    return out.withColumns({c: F.when(F.col("is_anomaly_pred") == 1, F.col(c)) for c in extra})


def needs_pattern(anomaly: DataFrame) -> DataFrame:
    """Windows whose pattern has to be classified."""
    return anomaly.where(F.col("is_anomaly_pred") == 1)


def assess(df: DataFrame, last: str = "last", default_threshold: float = R.SERVING_THRESHOLD,
           zero_when_normal: bool = True, detail: bool = False) -> DataFrame:
    """Verdict of a window with its risk.

    Expects ``mse, threshold, is_anomaly_pred, temporal_error_max``, pattern
    columns (``pattern, pattern_prob, probs_entropy, num_classes, similarity,
    latent_distance``) and the struct of the window's last packet.
    """
    finite = lambda c, d: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(d)).otherwise(
        F.coalesce(F.col(c), F.lit(d)))
    score, threshold = finite("mse", 0.0), finite("threshold", default_threshold)
    tmax = finite("temporal_error_max", 0.0)
    bad = F.col("is_anomaly_pred") == 1
    pkt = F.col(last)
    impact = R.impact(pkt["protocol"], pkt["src_asset"], pkt["dst_asset"])
    parts = R.risk(bad, score, threshold, tmax, F.col("pattern_prob"), F.col("probs_entropy"), F.col("num_classes"),
                   impact, zero_when_normal)
    more = [parts[k].alias(k) for k in ("impact", "likelihood", "confidence", "raw01", "cal01")] if detail else []
    risk = F.struct(parts["score"].alias("score"), pkt["timestamp"].alias("detected_time"), pkt["sip"].alias("src_ip"),
                    pkt["src_asset"].alias("src_asset"), pkt["dip"].alias("dst_ip"),
                    pkt["dst_asset"].alias("dst_asset"), *more)
    summary = F.struct(
        F.col("pattern_prob").alias("semantic_score"),
        F.when(bad, "anomalous").otherwise("normal").alias("anomaly_type"), score.alias("anomaly_score"),
        threshold.alias("threshold"), F.col("similarity"), F.col("probs_entropy").alias("similarity_entropy"),
        F.col("latent_distance"),
        (F.col("feature_error") if "feature_error" in df.columns
         else F.lit(None).cast("map<string,double>")).alias("feature_error"),
        tmax.alias("temporal_error_max"), risk.alias("risk"))
    return df.withColumn("summary", summary)


def normalise(df: DataFrame, now: Column | None = None, last: str = "last") -> DataFrame:
    """Fill what a verdict may lack: pattern ``UNKNOWN``, null metrics 0, detection time and ends from the last packet."""
    pkt, s = F.col(last), F.col("summary")
    r = s["risk"]
    stamp = F.coalesce(F.nullif(pkt["timestamp"], F.lit("")), now if now is not None else F.current_timestamp().cast("string"))
    seen = F.when(r["detected_time"].isNull() | r["detected_time"].isin("", "null"), stamp).otherwise(r["detected_time"])
    risk = F.struct(F.coalesce(r["score"], F.lit(0.0)).alias("score"), seen.alias("detected_time"),
                    F.coalesce(r["src_ip"], pkt["sip"]).alias("src_ip"),
                    F.coalesce(r["src_asset"], pkt["src_asset"]).alias("src_asset"),
                    F.coalesce(r["dst_ip"], pkt["dip"]).alias("dst_ip"),
                    F.coalesce(r["dst_asset"], pkt["dst_asset"]).alias("dst_asset"))
    zero = lambda n: F.coalesce(s[n], F.lit(0.0)).alias(n)
    summary = F.struct(zero("semantic_score"), s["anomaly_type"].alias("anomaly_type"), zero("anomaly_score"),
                       zero("threshold"), zero("similarity"), zero("similarity_entropy"), zero("latent_distance"),
                       F.coalesce(s["feature_error"], F.create_map().cast("map<string,double>")).alias("feature_error"),
                       zero("temporal_error_max"), risk.alias("risk"))
    return df.withColumn("pattern", F.coalesce("pattern", F.lit("UNKNOWN"))).withColumn("summary", summary)


def with_alert(df: DataFrame, model_alert: str | None = None) -> DataFrame:
    """Alert flag of a verdict."""
    s = F.col("summary")
    flag = R.alert(s["anomaly_score"], s["threshold"], s["anomaly_type"], s["risk"]["score"],
                   F.col(model_alert) if model_alert else None)
    return df.withColumn("alert", flag)


def alarm_payload(df: DataFrame, engine: str = "dl") -> DataFrame:
    """Alarm rows of the alerting windows: risk, sequence id, pattern and engine."""
    return df.where("alert").select(F.col("summary.risk").alias("risk"), "seq_id", "pattern", F.lit(engine).alias("engine"))
