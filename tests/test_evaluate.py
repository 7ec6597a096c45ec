"""Evaluation against numpy and counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtap.operators import evaluate as EV


def scored(spark, n=400, seed=2):
    r = random.Random(seed)
    rows = [(("big" if r.random() < 0.8 else "small"), i, r.randint(0, 1), float(r.randint(0, 40)) / 4) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i int, y int, s double").repartition(6)


def auc(pos, neg):
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def ap(rows):
    out, tp, fp, total = 0.0, 0, 0, sum(r[2] for r in rows)
    for s in sorted({r[3] for r in rows}, reverse=True):
        at = [r[2] for r in rows if r[3] == s]
        tp, fp = tp + sum(at), fp + len(at) - sum(at)
        out += sum(at) / total * tp / (tp + fp)
    return out


def test_areas(spark):
    rows, df = scored(spark)
    got = {r["g"]: r for r in EV.curve_areas(df, "g", "y", "s").collect()}
    for g in ("big", "small"):
        mine = [r for r in rows if r[0] == g]
        pos, neg = [r[3] for r in mine if r[2]], [r[3] for r in mine if not r[2]]
        assert got[g]["roc_auc"] == pytest.approx(auc(pos, neg))
        assert got[g]["pr_auc"] == pytest.approx(ap(mine))


def test_negated_scores_mirror_the_area(spark):
    _, df = scored(spark)
    a = EV.curve_areas(df, (), "y", "s").first()["roc_auc"]
    b = EV.curve_areas(df.withColumn("s", -F.col("s")), (), "y", "s").first()["roc_auc"]
    assert a + b == pytest.approx(1.0)


def test_one_class_has_no_curve(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    r = EV.curve_areas(df, (), "y", "s").first()
    assert r["roc_auc"] is None and r["pr_auc"] is None
    assert EV.roc_points(df, (), "y", "s").count() == 0


def test_average_precision_is_step_wise(spark):
    df = spark.createDataFrame([(1, .9), (0, .8), (1, .7), (1, .6), (0, .5), (0, .4)], "y int, s double")
    assert EV.curve_areas(df, (), "y", "s").first()["pr_auc"] == pytest.approx(0.8055555555)


def test_percentiles(spark):
    rows, df = scored(spark)
    got = {r["g"]: r for r in EV.score_distribution(df, "g", "s").collect()}
    for g in ("big", "small"):
        v = np.array([r[3] for r in rows if r[0] == g])
        for q in (5, 50, 95, 99):
            assert got[g][f"p{q}"] == pytest.approx(np.percentile(v, q))
        assert got[g]["std"] == pytest.approx(v.std()) and got[g]["count"] == len(v)


def test_percentiles_of_one_repeated_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 5.0).otherwise(F.col("id").cast("double")).alias("s"))
    got = {r["level"]: r["value"] for r in EV.exact_percentiles(df, (), "s", [50.0, 90.0, 99.0]).collect()}
    v = np.array([5.0] * 900 + list(range(900, 1000)))
    assert got == {q: pytest.approx(np.percentile(v, q)) for q in (50.0, 90.0, 99.0)}


def test_confusion_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, -1)], "y_true int, y_pred int")
    r = EV.confusion(df).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["accuracy"], r["balanced_accuracy"]) == (2, 0.0, 0.0, 0.0, 1.0, 0.5)


def test_roc_points(spark):
    df = spark.createDataFrame([(1, 4.0), (1, 3.0), (0, 2.0), (0, 1.0)], "y int, s double")
    pts = sorted((r["fpr"], r["tpr"]) for r in EV.roc_points(df, (), "y", "s").collect())
    # the straight stretches (0,.5) and (.5,1) lose their inner points
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)]
    assert EV.roc_points(df, (), "y", "s", drop_intermediate=False).count() == 5


def test_top_windows_forward_few_rows(spark):
    _, df = scored(spark)
    plan = EV.top_windows(df, "g", "s", 3, "i")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
