"""Evaluation of scored windows against ground truth.

Curves and percentiles are exact and need no global sort in one task: scores
are first aggregated to distinct values, cut into range blocks at approximate
quantiles, and accumulated block-wise (:mod:`railtap.operators.order`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.operators.order import Track, numeric_blocks, with_neighbour, with_running_sum
from railtap.session import checkpoint

# Percentile levels of a score distribution.
PERCENT_LEVELS = [*range(5, 100, 5), 99]


def _by(by) -> tuple[str, ...]:
    return (by,) if isinstance(by, str) else tuple(by)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


# --- ground truth and join -------------------------------------------------

def ground_truth(df: DataFrame, by=(), window_index: str | None = "window_index",
                 window_id: str | None = "window_id", is_anomaly: str | None = "is_anomaly",
                 pattern: str | None = "pattern") -> DataFrame:
    """One label per window: the index falls back to the id, the label to "pattern holds ATTACK"; repeats take the larger."""
    null = F.lit(None).cast("string")

    def col(n):
        return F.col(n).cast("string") if n and n in df.columns else null

    wi = F.coalesce(col(window_index), col(window_id)).try_cast("double")
    flag = col(is_anomaly).try_cast("double")
    named = F.upper(F.trim(F.coalesce(col(pattern), F.lit("")))).contains("ATTACK")
    label = F.when(col(is_anomaly).isNull(), named.cast("int")).otherwise(
        F.when(F.floor(flag) > 0, 1).otherwise(0))
    rows = df.select(*_by(by), F.floor(wi).cast("bigint").alias("window_index"), label.alias("y_true"))
    return rows.where(F.col("window_index").isNotNull()).groupBy(*_by(by), "window_index").agg(
        F.max("y_true").alias("y_true"))


def join_predictions(pred: DataFrame, truth: DataFrame, order: str, by=(), ignore_unknown: bool = False) -> DataFrame:
    """Windows present on both sides; of repeated predictions the last by ``order``; -1 predictions optionally dropped."""
    keys = [*_by(by), "window_index"]
    rest = [c for c in pred.columns if c not in (*keys, order)]
    pred = pred.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_p")).select(*keys, "_p.*")
    if ignore_unknown:
        pred = pred.where(F.col("y_pred") != -1)
    return pred.join(truth, keys)


# --- confusion -------------------------------------------------------------

def confusion(df: DataFrame, by=(), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts and rates of a binary verdict, 0 wherever a denominator is 0."""
    t, p = F.col(y_true) == 1, F.col(y_pred) > 0
    n = F.col(y_true) == 0
    c = df.groupBy(*_by(by)).agg(F.count_if(t & p).alias("tp"), F.count_if(n & ~p).alias("tn"),
                                 F.count_if(n & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    total = tp + tn + fp + fn
    precision, recall, tnr = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1 = _ratio(2 * precision * recall, precision + recall)
    return c.select(
        *_by(by), "tp", "tn", "fp", "fn", total.alias("num_samples"),
        _ratio(tp + tn, total).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), recall.alias("tpr"), _ratio(fp, fp + tn).alias("fpr"), tnr.alias("tnr"),
        _ratio(fn, fn + tp).alias("fnr"), _ratio(tp + fn, total).alias("prevalence"),
        _ratio(tp + fp, total).alias("pred_positive_rate"),
        (0.5 * (recall + tnr)).alias("balanced_accuracy"))


# --- exact percentiles -----------------------------------------------------

def exact_percentiles(df: DataFrame, by, value: str, levels: list[float]) -> DataFrame:
    """Linear-interpolated percentiles per group as long rows ``(by…, level, value)``.

    Only the rows that hold a wanted rank leave the accumulation, so neither a
    hot group nor its distinct values are ever gathered in one place.
    """
    by = _by(by)
    counts = (df.where(F.col(value).isNotNull()).withColumn("_g", F.lit(0))
              .groupBy("_g", *by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n")))
    counts = checkpoint(df.sparkSession, counts, "values")   # read three times below
    t = Track(("_g", *by), ("_x",), F.col("_b"))
    cum = with_running_sum(numeric_blocks(counts, "_x", "_b"), t, {"_cum": F.col("_n")})
    spot = [F.struct(F.lit(float(q)).alias("level"), (F.lit(q / 100.0) * (F.col("_cum_total") - 1)).alias("rank"))
            for q in levels]
    below, upto = F.col("_cum") - F.col("_n"), F.col("_cum")

    def holds(rank):
        return (rank >= below) & (rank < upto)

    near = F.filter(F.array(*spot), lambda s: holds(F.floor(s["rank"])) | holds(F.ceil(s["rank"])))
    hit = cum.where(F.size(near) > 0).select(*by, "_x", "_cum", "_n", F.explode(near).alias("_s"))
    lo, hi = F.floor(F.col("_s.rank")), F.ceil(F.col("_s.rank"))
    part = F.col("_s.rank") - lo
    ends = hit.groupBy(*by, F.col("_s.level").alias("level")).agg(
        F.max(F.when(holds(lo), F.col("_x"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_x"))).alias("_hi"),
        F.max(part).alias("_f"))
    return ends.select(*by, "level", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def score_distribution(df: DataFrame, by, score: str, levels=PERCENT_LEVELS) -> DataFrame:
    """Count, mean, population deviation, extremes and percentiles of a score per group."""
    by = _by(by)
    x = F.col(score)
    moments = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    # both halves have one row per group or level: stacking and folding them needs no join
    both = moments.unionByName(exact_percentiles(df, by, score, [float(q) for q in levels]), allowMissingColumns=True)
    return both.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("count", "mean", "std", "min", "max")],
        *[F.max(F.when(F.col("level") == float(q), F.col("value"))).alias(f"p{q}") for q in levels])


# --- curves ----------------------------------------------------------------

def step_counts(df: DataFrame, by, y_true: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score; written, as all that follows reads it several times."""
    at = df.groupBy(*_by(by), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos_at"), F.count_if(F.col(y_true) != 1).alias("neg_at"))
    return checkpoint(df.sparkSession, at, "scores")


def score_steps(at: DataFrame, by) -> tuple[DataFrame, Track]:
    """The steps of :func:`step_counts`, highest first, with positives and negatives down to each of them."""
    by = _by(by)
    at = at.withColumn("_g", F.lit(0)).withColumn("_down", -F.col("score"))
    t = Track(("_g", *by), ("_down",), F.col("_b"))
    cum = with_running_sum(numeric_blocks(at, "_down", "_b"), t,
                           {"pos": F.col("pos_at"), "neg": F.col("neg_at")})
    return cum, t


def roc_points(df: DataFrame, by, y_true: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """ROC curve points per group, from the origin (threshold infinity) down the distinct scores.

    ``drop_intermediate`` leaves out points on a straight stretch.  Groups with
    one class only have no curve.
    """
    by = _by(by)
    cum, t = score_steps(step_counts(df, by, y_true, score), by)
    cum = cum.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    if drop_intermediate:
        nxt = with_neighbour(cum, t, F.struct("pos_at", "neg_at"), "_next", ahead=True)
        first = (F.col("pos") == F.col("pos_at")) & (F.col("neg") == F.col("neg_at"))
        bend = (F.col("_next.pos_at") != F.col("pos_at")) | (F.col("_next.neg_at") != F.col("neg_at"))
        cum = nxt.where(first | F.col("_next").isNull() | bend)
    points = cum.select(*by, (F.col("neg") / F.col("neg_total")).alias("fpr"),
                        (F.col("pos") / F.col("pos_total")).alias("tpr"), F.col("score").alias("threshold"))
    classes = df.groupBy(*by).agg(F.count_if(F.col(y_true) == 1).alias("_p"),
                                  F.count_if(F.col(y_true) != 1).alias("_n"))
    origin = classes.where((F.col("_p") > 0) & (F.col("_n") > 0)).select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(origin)


def curve_areas(df: DataFrame, by, y_true: str, score: str) -> DataFrame:
    """ROC AUC (ties share a step) and step-wise average precision per group; null with one class only."""
    return _areas(step_counts(df, by, y_true, score), _by(by))


def _areas(steps: DataFrame, by) -> DataFrame:
    cum, _ = score_steps(steps, by)
    p, n = F.col("pos_total"), F.col("neg_total")
    both = (p > 0) & (n > 0)
    area = F.col("neg_at") / n * (F.col("pos") - F.col("pos_at") / 2.0) / p
    step = F.col("pos_at") / p * (F.col("pos") / (F.col("pos") + F.col("neg")))
    return cum.groupBy(*by).agg(F.sum(F.when(both, area)).alias("roc_auc"),
                                F.sum(F.when(both, step)).alias("pr_auc"),
                                F.max(p).alias("positives"), F.max(n).alias("negatives"))


def one_vs_rest(df: DataFrame, label: str, probs: str, ident: str) -> DataFrame:
    """One row per (row, class): did the row belong to the class, and the class probability."""
    e = df.select(ident, F.col(label).alias("_label"), F.posexplode(probs).alias("cls", "prob"))
    return e.select(ident, "cls", "prob", (F.col("_label") == F.col("cls")).cast("int").alias("hit"))


def multiclass_auc(df: DataFrame, label: str, probs: str, ident: str, top_n: int) -> DataFrame:
    """AUC rows: ``micro`` (all classes pooled), ``macro`` and the ``top_n`` classes by support."""
    # scored once and written: exploding an expression would evaluate it per class, and again in a filter Spark adds
    df = checkpoint(df.sparkSession, df.select(ident, label, probs), "probabilities")
    steps = step_counts(one_vs_rest(df, label, probs, ident), "cls", "hit", "prob")
    # -1: all classes pooled, whose steps are the classes' steps merged
    pooled = steps.groupBy("score").agg(F.lit(-1).alias("cls"), F.sum("pos_at").alias("pos_at"), F.sum("neg_at").alias("neg_at"))
    areas = _areas(steps.unionByName(pooled), ("cls",))
    # one entry per class from here on; a single pass over it gives all three kinds of rows
    entry = F.struct((-F.col("positives")).alias("order"), "cls", "roc_auc", F.col("positives").alias("support"))
    g = areas.agg(F.array_sort(F.collect_list(entry)).alias("a"))
    per = F.filter("a", lambda e: e["cls"] >= 0)
    known = F.filter(per, lambda e: e["roc_auc"].isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda t, e: t + e["roc_auc"]) / F.size(per)

    def row(scope: str, cls: Column, auc: Column, support: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), cls.cast("int").alias("cls"), auc.alias("roc_auc"),
                        support.cast("bigint").alias("support"))

    null = F.lit(None)
    micro = F.transform(F.filter("a", lambda e: e["cls"] < 0), lambda e: row("micro", null, e["roc_auc"], e["support"]))
    macro = F.array(row("macro", null, F.when(F.size(known) == F.size(per), mean), null))
    top = F.transform(F.filter(F.slice(per, 1, top_n), lambda e: e["roc_auc"].isNotNull()),
                      lambda e: row("class", e["cls"], e["roc_auc"], e["support"]))
    return g.select(F.inline(F.concat(micro, macro, top)))


def classification_report(df: DataFrame, label: str, predicted: str, prob_of_label: str | None = None) -> DataFrame:
    """Accuracy, support-weighted recall and F1, and mean log loss, from one confusion table."""
    loss = -F.log(F.greatest(F.col(prob_of_label), F.lit(1e-12))) if prob_of_label else F.lit(None).cast("double")
    cell = df.groupBy(F.col(label).alias("_t"), F.col(predicted).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(loss).alias("_loss"))
    true = cell.groupBy(F.col("_t").alias("c")).agg(
        F.sum("_n").alias("_support"), F.sum("_loss").alias("_loss"),
        F.coalesce(F.sum(F.when(F.col("_t") == F.col("_p"), F.col("_n"))), F.lit(0)).alias("_hit"))
    pred = cell.groupBy(F.col("_p").alias("c")).agg(F.sum("_n").alias("_called"))
    j = true.join(pred, "c", "left").withColumn("_called", F.coalesce("_called", F.lit(0)))
    rec, prec = _ratio(F.col("_hit"), F.col("_support")), _ratio(F.col("_hit"), F.col("_called"))
    f1 = _ratio(2 * rec * prec, rec + prec)
    n = F.sum("_support")
    return j.agg((F.sum("_hit") / n).alias("accuracy"), (F.sum(f1 * F.col("_support")) / n).alias("weighted_f1"),
                 (F.sum(rec * F.col("_support")) / n).alias("weighted_recall"),
                 (F.sum("_loss") / n).alias("mean_loss"), n.alias("n"))


# --- rankings and profiles -------------------------------------------------

def top_windows(df: DataFrame, by, score: str, k: int, tie: str) -> DataFrame:
    """The ``k`` highest-scored windows of every group; each map task forwards at most ``k`` per group."""
    w = W.partitionBy(*_by(by)).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_counts(df: DataFrame, label: str, top: int = 10) -> DataFrame:
    """The most frequent labels."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), label).limit(top))


def drop_labels(df: DataFrame, label: str, dropped: list[str], noise: bool = False) -> DataFrame:
    """Leave out rows without a label and those with a dropped one (``noise``: compared trimmed, case-blind)."""
    c = F.lower(F.trim(label)) if noise else F.col(label)
    return df.where(F.col(label).isNotNull() & ~c.isin(dropped))


def stage_summary(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Average, median, 95th percentile, extremes and count of stage durations."""
    d = score_distribution(df, stage, seconds, levels=[50, 95])
    return d.select(stage, F.col("mean").alias("avg"), "p50", "p95", "min", "max", F.col("count").alias("n"))
