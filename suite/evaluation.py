"""Evaluation queries: verdicts against truth over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.operators import evaluate as EV
from suite.base import query, round_doubles, sql_r6, table

_J = """j AS (SELECT d.doc_id AS window_index, lang AS tag, source, CAST(n_chars AS DOUBLE) AS score, toxic AS y_true, 1 - quality AS y_pred FROM documents d JOIN labels l USING (doc_id))"""


def judged(spark, sf):
    """Predictions joined with truth: score = length, truth = toxic, verdict = low quality."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("window_index"), F.col("lang").alias("tag"), "source",
                                             F.col("n_chars").cast("double").alias("score"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("window_index"), F.col("toxic").alias("y_true"),
                                            (1 - F.col("quality")).alias("y_pred"))
    return d.join(lab, "window_index")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


_COUNTS = """count(*) FILTER (y_true = 1 AND y_pred > 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred <= 0) AS tn,
 count(*) FILTER (y_true = 0 AND y_pred > 0) AS fp, count(*) FILTER (y_true = 1 AND y_pred <= 0) AS fn"""
_P, _R, _TNR = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), _ratio("tn", "tn + fp")
_RATES = f"""tp, tn, fp, fn, tp + tn + fp + fn AS num_samples, {sql_r6(_ratio('tp + tn', 'tp + tn + fp + fn'))} AS accuracy, {sql_r6(_P)} AS precision, {sql_r6(_R)} AS recall,
 {sql_r6(_ratio(f'2 * ({_P}) * ({_R})', f'({_P}) + ({_R})'))} AS f1, {sql_r6(_R)} AS tpr, {sql_r6(_ratio('fp', 'fp + tn'))} AS fpr, {sql_r6(_TNR)} AS tnr, {sql_r6(_ratio('fn', 'fn + tp'))} AS fnr,
 {sql_r6(_ratio('tp + fn', 'tp + tn + fp + fn'))} AS prevalence, {sql_r6(_ratio('tp + fp', 'tp + tn + fp + fn'))} AS pred_positive_rate, {sql_r6(f'0.5 * (({_R}) + ({_TNR}))')} AS balanced_accuracy"""


@query("confusion_metrics", f"WITH {_J}, c AS (SELECT {_COUNTS} FROM j) SELECT {_RATES} FROM c")
def confusion_metrics(spark, sf):
    """Counts and rates of the verdicts."""
    return round_doubles(EV.confusion(judged(spark, sf)))


@query("metrics_by_tag", f"WITH {_J}, c AS (SELECT tag, {_COUNTS} FROM j GROUP BY tag) SELECT tag, {_RATES} FROM c")
def metrics_by_tag(spark, sf):
    """The same per tag, all tags in one table."""
    return round_doubles(EV.confusion(judged(spark, sf), "tag"))


@query("prediction_join", """WITH t AS (SELECT doc_id AS window_index, max(CASE WHEN toxic > 0 THEN 1 ELSE 0 END) AS y_true FROM labels GROUP BY 1),
p AS (SELECT doc_id // 2 AS window_index, last(n_chars ORDER BY doc_id) AS score, last(CASE WHEN doc_id % 6 = 0 THEN -1 ELSE CAST(n_chars > 900 AS INT) END ORDER BY doc_id) AS y_pred FROM documents GROUP BY 1)
SELECT window_index, CAST(score AS BIGINT) AS score, CAST(y_pred AS INT) AS y_pred, y_true FROM p JOIN t USING (window_index) WHERE y_pred <> -1""")
def prediction_join(spark, sf):
    """Repeated predictions keep the last, unknown ones are ignored, both sides must know the window."""
    truth = EV.ground_truth(table(spark, sf, "labels").select(F.col("doc_id").alias("window_index"), F.col("toxic").alias("is_anomaly")))
    i = F.col("doc_id")
    pred = table(spark, sf, "documents").select(
        F.floor(i / 2).alias("window_index"), i.alias("at"), F.col("n_chars").alias("score"),
        F.when(i % 6 == 0, -1).otherwise((F.col("n_chars") > 900).cast("int")).alias("y_pred"))
    return EV.join_predictions(pred, truth, ignore_unknown=True, order="at").select("window_index", "score", "y_pred", "y_true")


@query("ground_truth_labels", """SELECT conv_id AS window_index, max(CASE WHEN turn % 3 = 0 THEN CAST(contains(upper(text), 'ATTACK') OR contains(upper(text), 'THE') AS INT)
 WHEN turn % 3 = 1 THEN 0 ELSE CAST(length(text) > 200 AS INT) END) AS y_true FROM conversations GROUP BY conv_id""")
def ground_truth_labels(spark, sf):
    """Labels from a flag where there is one, else from the pattern text; repeats take the larger."""
    t, text = F.col("turn") % 3, F.col("text")
    flag = F.when(t == 1, "0").when(t == 2, (F.length(text) > 200).cast("int").cast("string"))
    named = F.when(F.upper(text).contains("ATTACK") | F.upper(text).contains("THE"), "an attack").otherwise("calm")
    rows = table(spark, sf, "conversations").select(
        F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).alias("window_index"),
        F.col("conv_id").cast("string").alias("window_id"), flag.alias("is_anomaly"), named.alias("pattern"))
    return EV.ground_truth(rows)


_LEVELS = [*range(5, 100, 5), 99]


def _sql_dist(col: str) -> str:
    return (f"count({col}) AS count, {sql_r6(f'avg({col})')} AS mean, {sql_r6(f'stddev_pop({col})')} AS std, {sql_r6(f'min({col})')} AS \"min\", {sql_r6(f'max({col})')} AS \"max\", "
            + ", ".join(f"{sql_r6(f'quantile_cont({col}, {q / 100.0})')} AS p{q}" for q in _LEVELS))


@query("score_distribution", f"WITH {_J} SELECT y_true, {_sql_dist('score')} FROM j GROUP BY y_true")
def score_distribution(spark, sf):
    """Score moments and percentiles of attack and normal windows."""
    return round_doubles(EV.score_distribution(judged(spark, sf), "y_true", "score"))


@query("score_distribution_by_group", f"WITH {_J} SELECT source, tag, {_sql_dist('score')} FROM j GROUP BY source, tag")
def score_distribution_by_group(spark, sf):
    """The same per source and tag."""
    return round_doubles(EV.score_distribution(judged(spark, sf), ["source", "tag"], "score"))


@query("top_windows", f"WITH {_J}, r AS (SELECT y_true, window_index, score, row_number() OVER (PARTITION BY y_true ORDER BY score DESC, window_index) AS rk FROM j) SELECT y_true, window_index, score, CAST(rk AS INT) AS rank FROM r WHERE rk <= 10")
def top_windows(spark, sf):
    """The ten highest-scored windows per label."""
    return EV.top_windows(judged(spark, sf), "y_true", "score", 10, "window_index").select("y_true", "window_index", "score", "rank")


@query("results_in_order", f"WITH {_J} SELECT window_index, score, y_true FROM j ORDER BY window_index")
def results_in_order(spark, sf):
    """Results sorted by window index; a range-partitioned sort."""
    return judged(spark, sf).select("window_index", "score", "y_true").orderBy("window_index")


_STEPS = f"""{_J}, a AS (SELECT tag, score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true <> 1) AS n FROM j GROUP BY tag, score),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY tag) AS tp, sum(n) OVER (PARTITION BY tag) AS tn,
 lead(p) OVER (PARTITION BY tag ORDER BY score DESC) AS np, lead(n) OVER (PARTITION BY tag ORDER BY score DESC) AS nn, row_number() OVER (PARTITION BY tag ORDER BY score DESC) AS rn FROM a WINDOW w AS (PARTITION BY tag ORDER BY score DESC))"""


@query("roc_points", f"""WITH {_STEPS} SELECT tag, {sql_r6('cn / tn')} AS fpr, {sql_r6('cp / tp')} AS tpr, score AS threshold FROM c WHERE tp > 0 AND tn > 0 AND (rn = 1 OR np IS NULL OR np <> p OR nn <> n)
UNION ALL SELECT DISTINCT tag, 0.0, 0.0, 'Infinity'::DOUBLE FROM c WHERE tp > 0 AND tn > 0""")
def roc_points(spark, sf):
    """ROC curve per tag without points on straight stretches."""
    return round_doubles(EV.roc_points(judged(spark, sf), "tag", "y_true", "score"), "threshold")


@query("roc_points_all", f"""WITH {_STEPS} SELECT tag, {sql_r6('cn / tn')} AS fpr, {sql_r6('cp / tp')} AS tpr, score AS threshold FROM c WHERE tp > 0 AND tn > 0
UNION ALL SELECT DISTINCT tag, 0.0, 0.0, 'Infinity'::DOUBLE FROM c WHERE tp > 0 AND tn > 0""")
def roc_points_all(spark, sf):
    """ROC curve per tag, one point per distinct score."""
    return round_doubles(EV.roc_points(judged(spark, sf), "tag", "y_true", "score", drop_intermediate=False), "threshold")


@query("roc_auc", f"WITH {_STEPS} SELECT tag, {sql_r6('sum(n / tn * (cp - p / 2.0) / tp) FILTER (tp > 0 AND tn > 0)')} AS roc_auc FROM c GROUP BY tag")
def roc_auc(spark, sf):
    """Area under the ROC curve per tag."""
    return round_doubles(EV.curve_areas(judged(spark, sf), "tag", "y_true", "score").select("tag", "roc_auc"))


@query("average_precision", f"WITH {_STEPS} SELECT tag, {sql_r6('sum(p / tp * (cp / (cp + cn))) FILTER (tp > 0 AND tn > 0)')} AS pr_auc FROM c GROUP BY tag")
def average_precision(spark, sf):
    """Step-wise average precision per tag."""
    return round_doubles(EV.curve_areas(judged(spark, sf), "tag", "y_true", "score").select("tag", "pr_auc"))


@query("stage_summary", f"""SELECT event_type AS stage, {sql_r6('avg(value)')} AS avg, {sql_r6('quantile_cont(value, 0.5)')} AS p50, {sql_r6('quantile_cont(value, 0.95)')} AS p95, {sql_r6('min(value)')} AS "min",
 {sql_r6('max(value)')} AS "max", count(value) AS n FROM events GROUP BY 1""")
def stage_summary(spark, sf):
    """Duration summary per stage."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    return round_doubles(EV.stage_summary(ev, "stage", "value"))


@query("cv_summary", f"""WITH {_J}, f AS (SELECT tag, window_index % 3 AS fold, avg(CAST(y_true = y_pred AS INT)) AS accuracy, avg(score) AS loss FROM j GROUP BY 1, 2)
SELECT tag, {sql_r6('avg(accuracy)')} AS accuracy, {sql_r6('avg(loss)')} AS loss, count(*) AS folds FROM f GROUP BY tag""")
def cv_summary(spark, sf):
    """Fold averages per candidate."""
    from railtap.plans.training import cv_summary as summary
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    folds = judged(spark, sf).groupBy("tag", (F.col("window_index") % 3).alias("fold")).agg(
        F.avg(hit).alias("accuracy"), F.avg("score").alias("loss"))
    return round_doubles(summary(folds, "tag", ["accuracy", "loss"]))
