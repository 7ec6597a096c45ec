"""Window scoring jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.operators.evaluate import exact_percentiles
from railtap.operators.order import Track, with_ordinal
from railtap.operators.windows import sliding
from railtap.session import checkpoint


def score_windows(packets: DataFrame, t: Track, score: Column, attack: Column, size: int, step: int,
                  level: float = 99.0) -> DataFrame:
    """Every full window with its mean score, label, verdict and last packet.

    The threshold is the given percentile of the scores of attack-free windows;
    it is one number, so it is read and put into the plan as a literal.
    """
    rows = with_ordinal(packets.withColumn("_score", score).withColumn("_attack", attack), t, "_i")
    last = F.struct("sip", "dip", "timestamp")
    w = sliding(rows, t.by, "_i", size, step, {"score": ("avg", F.col("_score")), "truth": ("any", F.col("_attack")),
                                              "last": ("last", last)})
    w = checkpoint(packets.sparkSession, w, "windows")   # read for the threshold and for the verdicts
    got = exact_percentiles(w.where(~F.col("truth")), (), "score", [level]).select("value").collect()
    threshold = F.lit(float(got[0][0])) if got else F.lit(None).cast("double")
    return w.select(*t.by, "window_id", "start", "end", "score", F.col("truth").cast("int").alias("y_true"),
                    F.when(threshold.isNull(), F.lit(-1)).otherwise((F.col("score") > threshold).cast("int")).alias("y_pred"),
                    F.col("last.sip").alias("src_ip"), F.col("last.dip").alias("dst_ip"),
                    F.col("last.timestamp").alias("detected_time"))
