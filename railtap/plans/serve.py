"""The whole flow over packets at rest: merge, featurise, window, score, judge; and labelled captures for evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.functions.risk import SERVING_THRESHOLD, class_summary
from railtap.operators import score as SC
from railtap.operators import verdict as V
from railtap.operators.attack import attack_flag
from railtap.operators.features import featurise
from railtap.operators.fit import Fitted
from railtap.operators.merge import CHUNK_ROWS, group_sketch, groups, merge_online, online_key
from railtap.operators.order import Track, with_ordinal
from railtap.operators.windows import compact, dense_cells, sliding
from railtap.schema import MERGE_PROTOCOLS, MISSING, OUT_OF_RANGE
from railtap.session import checkpoint, condensed

_CONTEXT = ["protocol", "timestamp", "sip", "dip", "src_asset", "dst_asset"]


def merged_packets(packets: DataFrame, t: Track, order: str, protocols=MERGE_PROTOCOLS,
                   key: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Packets after the merge, one per group of any length, with their dense position ``i`` in the capture.

    ``sketch`` holds what the features need of a group's lists; the list fields
    themselves are those of the group's first chunk.  The envelope's time, where
    packets have one (``meta.packet_ts_ms``), is the time of the merge key.

    A packet that is all of its group is its own merge and has no lists, so its
    sketch is null; only the others are dealt out by group.
    """
    if key is None:
        envelope = "meta" in packets.columns
        key = online_key(packets, protocols, ts_ms="meta.packet_ts_ms" if envelope else None)
    grouped = checkpoint(packets.sparkSession, groups(packets, t, key, alone="_alone"), "grouped")
    alone, several = grouped.where("_alone").drop("_alone"), grouped.where("NOT _alone").drop("_alone")
    merged = merge_online(several, t.by, order, protocols, chunk_rows, written=True).where("chunk = 0").drop("chunk")
    merged = merged.join(group_sketch(several, t.by, protocols, chunk_rows), [*t.by, "merge_event_id"], "left")
    alone = alone.withColumns({"raw_count": F.lit(1), "sketch": F.lit(None)})
    merged = merged.unionByName(alone.select(*[F.col(f.name).cast(f.dataType) for f in merged.schema]))
    return merged.withColumn("i", F.col("merge_event_id") - 1)   # groups are numbered without gaps


def feature_cells(rows: DataFrame, capture: str, fitted: Fitted, features: list[str], missing: float = OUT_OF_RANGE,
                  extra: dict | None = None) -> DataFrame:
    """Capture, position ``i``, feature vector and context of every packet; ``rows`` are packets with position ``i``."""
    context = [c if c in rows.columns else None for c in _CONTEXT]
    rows = rows.withColumn("_last", F.struct(*[(F.col(c) if c else F.lit(None).cast("string")).alias(n)
                                               for n, c in zip(_CONTEXT, context)]))
    more = {f"_x_{n}": e for n, (_, e) in (extra or {}).items()}
    rows = rows.withColumns(more) if more else rows
    feats = featurise(rows, fitted, [capture, "i", "_last", *more])
    return feats.select(capture, "i", "_last", *more, dense_cells(features, missing).alias("_v"))


def cell_windows(cells: DataFrame, capture: str, size: int, step: int, tail: str = "drop", extra: dict | None = None) -> DataFrame:
    """Windows over :func:`feature_cells`: feature vectors ``x`` with the last packet's context and the ``extra`` aggregates."""
    aggs = {"x": ("rows", F.col("_v")), "last": ("last", F.col("_last"))}
    aggs |= {n: (kind, F.col(f"_x_{n}")) for n, (kind, _) in (extra or {}).items()}
    return sliding(cells, capture, "i", size, step, aggs, tail=tail)


def feature_windows(rows: DataFrame, capture: str, fitted: Fitted, features: list[str], size: int, step: int,
                    missing: float = OUT_OF_RANGE, tail: str = "drop", extra: dict | None = None) -> DataFrame:
    """Windows of feature vectors ``x`` with the last packet's context; ``extra`` adds window aggregates.

    ``rows`` are packets with position ``i``.
    """
    return cell_windows(feature_cells(rows, capture, fitted, features, missing, extra), capture, size, step, tail, extra)


def merged_cells(packets: DataFrame, t: Track, order: str, fitted: Fitted, features: list[str]) -> DataFrame:
    """Feature cells of the merged packets, written: narrow, and all that windows of any step read of a capture."""
    return condensed(packets.sparkSession, lambda: feature_cells(
        merged_packets(packets, t, order), t.by[0], fitted, features), "cells")


def serve(packets: DataFrame, t: Track, order: str, fitted: Fitted, features: list[str],
          reconstruct: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame] | None = None,
          labels: list[str] | None = None, size: int = 80, step: int = 5, threshold: float = SERVING_THRESHOLD,
          weights: list[float] | None = None, always_classify: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """Verdict of every full window of a capture.

    ``cells`` are the packets' :func:`merged_cells`, where the caller has them already.

    ``reconstruct`` adds ``xh`` to windows holding ``x``; ``classify`` adds the
    class probabilities ``probs`` to windows holding the compacted ``seq``.
    Without ``always_classify`` it is given the anomalous windows only.
    """
    capture = t.by[0]
    keys = [capture, "window_id"]
    if cells is None:
        cells = merged_cells(packets, t, order, fitted, features)
    w = cell_windows(cells, capture, size, step)
    scored = reconstruct(w).withColumn("_se", SC.squared_errors(F.col("x"), F.col("xh"), weights))
    x = ["x"] if classify else []   # the pattern model alone reads the windows again
    scored = scored.select(*keys, "start", "end", "last", *x, SC.error_serve(F.col("x"), F.col("_se")).alias("mse"),
                           SC.temporal_error_max(F.col("_se")).alias("temporal_error_max"),
                           SC.top_feature_errors(F.col("_se"), features).alias("feature_error"))
    scored = scored.withColumn("threshold", F.lit(float(threshold))) \
                   .withColumn("is_anomaly_pred", SC.anomaly_prediction(F.col("mse"), threshold))
    # the windows feed the verdicts and the pattern model: written once instead of scored twice
    scored = checkpoint(packets.sparkSession, scored, "scored")
    empty = {"pattern": "string", "pattern_prob": "double", "probs_entropy": "double", "num_classes": "int",
             "similarity": "double", "latent_distance": "double"}
    if classify is None:
        out = scored.withColumns({c: F.lit(None).cast(d) for c, d in empty.items()})
    else:
        todo = scored if always_classify else V.needs_pattern(scored)
        probs = classify(todo.select(*keys, compact(F.col("x"), size).alias("seq")))
        s = class_summary(F.col("probs"))
        names = F.array(*[F.lit(n) for n in labels or []])
        name = F.coalesce(F.get(names, s["pattern_index"]) if labels else F.lit(None).cast("string"),
                          F.concat(F.lit("class_"), s["pattern_index"].cast("string")))
        pattern = probs.select(*keys, name.alias("pattern"), *[s[c].alias(c) for c in empty if c != "pattern"])
        out = V.merge_results(scored, pattern, keys, always_classify)
    done = V.with_alert(V.normalise(V.assess(out)))
    return done.select(*keys, (F.col("window_id") + 1).alias("seq_id"), "start", "end", "pattern", "summary", "alert")


def labelled_windows(packets: DataFrame, t: Track, fitted: Fitted, features: list[str], mode: Column, size: int,
                     step: int) -> DataFrame:
    """Windows of a labelled capture, short ones at the end included: ``x``, ``y_true`` and the pattern name."""
    c = lambda n: F.col(n) if n in packets.columns else F.lit(None).cast("string")
    flag = attack_flag(mode, c("protocol"), c("modbus_fc"), c("xgt_fen_cmd"), c("xgt_fen_vars"), c("xgt_fen_data"))
    rows = with_ordinal(packets, t, "i")
    w = feature_windows(rows, t.by[0], fitted, features, size, step, missing=MISSING, tail="keep",
                        extra={"hit": ("any", flag)})
    return w.withColumns({"y_true": F.col("hit").cast("int"),
                          "pattern": F.when(F.col("hit"), "ATTACK").otherwise("NORMAL")}).drop("hit")
