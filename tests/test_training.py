"""Training against plain linear algebra, held-out accuracy, stored models."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtap.plans import training as TR
from railtap.session import fresh_path
from railtap.sources import params as P


def windows(spark, n, steps, width, rank, noise=0.05, seed=1, least=-6.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) * np.arange(rank, 0, -1) @ rng.normal(size=(rank, steps * width)) + noise * rng.normal(size=(n, steps * width))
    x[x < least] = -1.0   # cells without a value
    rows = [(i, x[i].reshape(steps, width).tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "id int, x array<array<double>>").repartition(4)


@pytest.mark.parametrize("k", [2, 3, 30])
def test_axes_equal_an_eigen_decomposition(spark, k):
    x, df = windows(spark, 150, 5, 6, rank=3)
    weights = [1.0 + 0.5 * i for i in range(6)]
    rec = TR._fit(df, "x", 5, 6, k, weights)
    seen = x != -1.0
    mean, root = (x * seen).sum(axis=0) / seen.sum(axis=0), np.tile(np.sqrt(weights), 5)
    c = np.where(seen, x - mean, 0.0) * root
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :k]
    want = c @ axes @ axes.T / root + mean
    got = np.array([r["xh"] for r in rec.apply(df).orderBy("id").collect()]).reshape(150, -1)
    assert np.allclose(got, want, atol=2e-3) and np.allclose(rec.mean[0], mean)


def test_wide_windows_need_no_square_matrix(spark):
    x, df = windows(spark, 120, 40, 26, rank=4, noise=0.0, least=-np.inf)
    rec = TR._fit(df, "x", 40, 26, 4, [1.0] * 26)
    assert rec.basis[0].shape == (1040, 4)
    got = np.array([r["xh"] for r in rec.apply(df).orderBy("id").collect()]).reshape(120, -1)
    assert np.abs(got - x).max() < 1e-6


def test_members_are_fitted_on_their_draws(spark):
    x, df = windows(spark, 80, 3, 4, rank=2, noise=0.5)
    rec = TR.bagged_reconstructor(df, "id", "x", 3, 4, k=2, members=3)
    draw = lambda m, i: int(hashlib.md5(f"42|{m}|{i}".encode()).hexdigest()[:8], 16) % 1_000_000
    for m in range(3):
        n = np.array([sum(draw(m, i) >= p for p in TR._POISSON) for i in range(80)])
        rows = np.repeat(x, n, axis=0)
        seen = rows != -1.0
        mean = (rows * seen).sum(axis=0) / seen.sum(axis=0)
        c = np.where(seen, rows - mean, 0.0)
        axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :2]
        assert np.allclose(rec.mean[m], mean)
        assert np.allclose(rec.basis[m] @ rec.basis[m].T, axes @ axes.T, atol=1e-3)
    path = fresh_path(spark, "test-bagged")
    rec.save(path)
    one, other = ([r["xh"] for r in m.apply(df).orderBy("id").collect()] for m in (rec, TR.Reconstructor.load(path)))
    assert one == other


def patterns(spark, n=240):
    """Three kinds of sequences that differ in level and shape, the label nowhere among the cells."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        kind = i % 3
        t = np.linspace(0, 1, rng.integers(6, 13))
        base = (np.sin(6 * t), 2 * t - 1, np.where(t > 0.5, 1.0, -0.5))[kind]
        rows.append((i, ("wave", "ramp", "step")[kind], np.column_stack([base, base[::-1] * 0.5]) + 0.15 * rng.normal(size=(len(t), 2))))
    return spark.createDataFrame([(i, k, x.tolist()) for i, k, x in rows], "id int, label string, seq array<array<double>>")


def test_classifier_holds_out(spark):
    df = patterns(spark).withColumn("v", TR.pooled(F.col("seq"), 2))
    _, scored, cv = TR.train_classifier(df, "id", "label", "v")
    right = scored.agg(F.avg((F.col("y") == F.col("pattern_index")).cast("double"))).first()[0]
    assert scored.count() > 25 and right >= 0.9
    assert cv.count() == 2 and cv.agg(F.max("avg_f1")).first()[0] >= 0.85


def test_stored_classifier_gives_the_same_classes(spark):
    df = patterns(spark).withColumn("v", TR.pooled(F.col("seq"), 2))
    pipe, _, cal = TR.train_classifier(df, "id", "label", "v")
    path = fresh_path(spark, "test-bundle")
    fresh = TR.Bundle(pipe, P.catalog(spark, ["a", "b"]), spark.createDataFrame([(0.5,)], "threshold_p99 double"), {"width": "2"})
    fresh.save(path)
    again = TR.Bundle.load(spark, path)
    names = TR.class_names(again)
    assert sorted(names) == ["ramp", "step", "wave"]
    todo = df.select("id", "seq")
    one, other = ({r["id"]: [round(p, 9) for p in r["probs"]] for r in TR.classify_with(b, 2)(todo).collect()} for b in (fresh, again))
    assert one == other
    truth = {r["id"]: r["label"] for r in df.collect()}
    best = {i: names[int(np.argmax(p))] for i, p in one.items()}
    assert np.mean([best[i] == truth[i] for i in truth]) >= 0.9


def test_patterns_are_asked_for_anomalous_windows_only(spark):
    from railtap.operators import verdict as V
    scored = spark.createDataFrame([("a", 0, 0, 0.1), ("a", 1, 1, 0.9), ("b", 0, 1, 0.8)], "capture string, window_id int, is_anomaly_pred int, mse double")
    assert {(r["capture"], r["window_id"]) for r in V.needs_pattern(scored).collect()} == {("a", 1), ("b", 0)}
